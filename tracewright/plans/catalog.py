"""Registered queries over the trace tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import callstack, compare, counters, critical_path, dag, drilldown, filters, intervals, kernels, parallel, silver
from ..operators.keep import kept
from . import threaded
from .fixtures import TR, trace_events
from .pipeline_fixtures import ANNOTATED, MICRO_BATCHES, STAGES, STEPS, TRANSFERS, VIRTUAL, annotated, steps, transfers

#: Buckets of range joins on this data: times are months in microseconds, spans last minutes.
WIDTH = 600_000_000
#: Segments of scans, µs: the fixture is a month long, so a day.
SEGMENT = 86_400_000_000
#: Delay below which a gap counts as waiting for the kernel, on this data's scale.
DELAY = 30_000_000

#: Events by the number of a rank, stage or step that they fall on.
ON = lambda n: f"SELECT user_id % {n} AS on_, count(*) AS n FROM events GROUP BY 1"


def events_on(spark, sf_dir, n: int, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % n).cast("int").alias(column)).agg(F.count("*").alias("n"))


QUERIES: dict = dict(threaded.QUERIES)
ORACLES: dict[str, str] = dict(threaded.ORACLES)


def query(name: str, sql: str | None = None):
    """Register a function of events, with SQL over the expressions in TR."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(trace_events(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {TR}" + (sql if sql.lstrip().startswith(",") else "\n" + sql)
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


GPU = """, gpu AS (SELECT *, CASE WHEN regexp_matches(name, '^(?:(^nccl.*)|(^hip)|(^hccl)|(.*ncclKernel.*))') THEN 'COMMUNICATION'
 WHEN regexp_matches(name, '^(?:(^(hip)?Memcpy)|(^(hip)?Memset)|(^dma))') THEN 'MEMORY' ELSE 'COMPUTATION' END AS kernel_type FROM tr WHERE stream <> -1)"""


def merged(source: str, keys: str, name: str) -> str:
    return f""", {name}_f AS (SELECT {keys}, ts, "end", CASE WHEN ts > max("end") OVER (PARTITION BY {keys} ORDER BY ts, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM {source}),
{name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY ts, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f),
{name} AS (SELECT {keys}, min(ts) AS ts, max("end") AS "end" FROM {name}_g GROUP BY {keys}, island)"""


def swept(name: str, bits: str) -> str:
    return (
        GPU
        + f", bitted AS (SELECT *, {bits} AS bit FROM gpu), wanted AS (SELECT * FROM bitted WHERE bit IS NOT NULL)"
        + merged("wanted", "rank, bit", "isl")
        + f""", pts AS (SELECT rank, ts AS moment, bit AS delta FROM isl UNION ALL SELECT rank, "end", -bit FROM isl),
steps AS (SELECT rank, moment, sum(delta) AS delta FROM pts GROUP BY rank, moment),
run AS (SELECT rank, moment AS ts, lead(moment) OVER (PARTITION BY rank ORDER BY moment) AS "end", sum(delta) OVER (PARTITION BY rank ORDER BY moment ROWS UNBOUNDED PRECEDING) AS state FROM steps),
{name} AS (SELECT *, "end" - ts AS len FROM run WHERE state > 0 AND "end" > ts)"""
    )


@query(
    "kernel_type_breakdown",
    swept("seg", "CASE kernel_type WHEN 'COMPUTATION' THEN 1 WHEN 'COMMUNICATION' THEN 2 WHEN 'MEMORY' THEN 4 END")
    + """ SELECT kernel_type, CAST(sum AS BIGINT) AS sum, round_even(sum * 100.0 / sum(sum) OVER (), 1) AS percentage FROM (
 SELECT CASE CAST(state AS INT) WHEN 1 THEN 'COMPUTATION' WHEN 2 THEN 'COMMUNICATION' WHEN 3 THEN 'COMPUTATION overlapping COMMUNICATION' WHEN 4 THEN 'MEMORY'
  WHEN 5 THEN 'COMPUTATION overlapping MEMORY' WHEN 6 THEN 'COMMUNICATION overlapping MEMORY' ELSE 'COMPUTATION overlapping COMMUNICATION overlapping MEMORY' END AS kernel_type,
  sum(len) AS sum FROM seg GROUP BY 1) s""",
)
def kernel_type_breakdown(events):
    return kernels.type_breakdown(events, segment=SEGMENT)


STATS = 'sum(dur) AS sum, max(dur) AS max, min(dur) AS min, round(avg(dur), 1) AS mean, round(coalesce(stddev_samp(dur), 0), 1) AS stddev'


@query("gpu_kernel_stats_by_name", GPU + f" SELECT rank, kernel_type, name, {STATS} FROM gpu GROUP BY ALL")
def gpu_kernel_stats(events):
    return rounded(kernels.time_statistics(kernels.gpu_rows(events), ["rank", "kernel_type", "name"]), "mean", "stddev", digits=1)


@query(
    "gpu_kernel_top_with_others",
    f""", s AS (SELECT rank, name, sum(dur) AS sum, max(dur) AS max, min(dur) AS min, avg(dur) AS mean, coalesce(stddev_samp(dur), 0) AS stddev FROM tr WHERE stream <> -1 GROUP BY rank, name),
r AS (SELECT *, sum(sum) OVER (PARTITION BY rank ORDER BY sum DESC, name ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY rank ORDER BY sum DESC, name) AS place, count(*) OVER (PARTITION BY rank) AS n FROM s),
q AS (SELECT rank AS qr, quantile_cont(run, 0.8) AS cut FROM r GROUP BY rank),
m AS (SELECT rank, CASE WHEN run > cut OR place > 3 THEN 'others' ELSE name END AS name, sum AS dur FROM r JOIN q ON rank = qr WHERE n > 3)
SELECT rank, name, {STATS} FROM m GROUP BY rank, name
UNION ALL SELECT rank, name, sum, max, min, round(mean, 1), round(stddev, 1) FROM r WHERE n <= 3""",
)
def gpu_kernel_top(events):
    stats = kernels.time_statistics(kernels.gpu_rows(events), ["rank", "name"])
    return rounded(kernels.top_with_others(stats, ["rank"], 3), "mean", "stddev", digits=1)


@query("merged_kernel_intervals", GPU + merged("gpu", "rank", "isl") + ' SELECT rank, ts, "end" FROM isl')
def merged_kernel_intervals(events):
    return intervals.merge_intervals(kernels.gpu_rows(events), ["rank"], segment=SEGMENT)


@query(
    "temporal_breakdown",
    GPU + merged("gpu", "rank", "a") + ", comp AS (SELECT * FROM gpu WHERE kernel_type = 'COMPUTATION')" + merged("comp", "rank", "c_")
    + """, x AS (SELECT rank, max("end") - min(ts) AS kernel_time, sum("end" - ts) AS busy FROM a GROUP BY rank),
y AS (SELECT rank AS r, sum("end" - ts) AS comp FROM c_ GROUP BY rank),
z AS (SELECT rank, kernel_time, kernel_time - busy AS idle_time, coalesce(comp, 0) AS compute_time, busy - coalesce(comp, 0) AS non_compute_time FROM x LEFT JOIN y ON rank = r)
SELECT *, round_even(idle_time * 100.0 / kernel_time, 2) AS idle_time_pctg, round_even(compute_time * 100.0 / kernel_time, 2) AS compute_time_pctg,
 round_even(non_compute_time * 100.0 / kernel_time, 2) AS non_compute_time_pctg FROM z""",
)
def temporal_breakdown(events):
    return kernels.temporal_breakdown(events, SEGMENT)


@query(
    "comm_comp_overlap",
    swept("seg", "CASE kernel_type WHEN 'COMPUTATION' THEN 1 WHEN 'COMMUNICATION' THEN 2 END")
    + " SELECT rank, round_even(coalesce(sum(len) FILTER (state = 3), 0) * 100.0 / sum(len) FILTER (state >= 2), 2) AS comp_comm_overlap_pctg FROM seg GROUP BY rank",
)
def comm_comp_overlap(events):
    return kernels.communication_overlap(events, SEGMENT)


GAPS = """, k AS (SELECT * FROM tr WHERE stream <> -1 AND cat IN ('kernel', 'gpu_memcpy', 'gpu_memset')), h AS (SELECT rank AS hr, corr AS hc, ts AS lts FROM tr WHERE stream = -1 AND corr >= 0),
g0 AS (SELECT k.*, lts, lag("end") OVER (PARTITION BY rank, stream ORDER BY ts, idx) AS before FROM k LEFT JOIN h ON rank = hr AND corr = hc),
gaps AS (SELECT *, ts - before AS gap, CASE WHEN lts > before THEN 'host_wait' WHEN ts - before < 30000000 THEN 'kernel_wait' ELSE 'other' END AS idle_category FROM g0)"""


def described(value: str) -> str:
    return (
        f"count({value}) AS count, round(avg({value}), 3) AS mean, round(stddev_samp({value}), 3) AS std, min({value}) AS min, round(quantile_cont({value}, 0.25), 3) AS q25, "
        f"round(quantile_cont({value}, 0.5), 3) AS q50, round(quantile_cont({value}, 0.75), 3) AS q75, max({value}) AS max"
    )


@query(
    "idle_time_breakdown",
    GAPS + """, s AS (SELECT rank, stream, idle_category, CAST(coalesce(sum(gap), 0) AS BIGINT) AS idle_time FROM gaps GROUP BY ALL)
SELECT *, round_even(idle_time / sum(idle_time) OVER (PARTITION BY rank, stream), 2) AS idle_time_ratio FROM s""",
)
def idle_time_breakdown(events):
    return counters.idle_breakdown(counters.idle_gaps(events, DELAY))


@query("idle_interval_stats", GAPS + f" SELECT rank, stream, idle_category, {described('gap')} FROM gaps WHERE gap IS NOT NULL GROUP BY ALL")
def idle_interval_stats(events):
    return rounded(counters.idle_statistics(counters.idle_gaps(events, DELAY)), "mean", "std", "q25", "q50", "q75")


QUEUE = """, hh AS (SELECT * FROM tr WHERE name IN ('cudaLaunchKernel', 'cudaMemcpyAsync', 'cudaMemsetAsync')), kk AS (SELECT * FROM tr WHERE stream <> -1 AND corr >= 0),
pp AS (SELECT kk.rank, kk.stream, hh.ts AS lts, hh.idx AS lidx, kk.ts AS kts, kk.idx AS kidx FROM hh JOIN kk ON hh.rank = kk.rank AND hh.corr = kk.corr),
dd AS (SELECT rank, stream, lts AS ts, lidx AS index, 1 AS delta FROM pp UNION ALL SELECT rank, stream, kts, kidx, -1 FROM pp),
series AS (SELECT rank, stream, ts, index, CAST(sum(delta) OVER (PARTITION BY rank, stream ORDER BY ts, delta DESC, index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queue_length, delta FROM dd)"""


@query("queue_length_series", QUEUE + " SELECT rank, stream, ts, index, queue_length FROM series")
def queue_length_series(events):
    return counters.queue_series(events, SEGMENT).drop("delta")


@query("queue_length_summary", QUEUE + f" SELECT rank, stream, {described('queue_length')} FROM series GROUP BY ALL")
def queue_length_summary(events):
    return rounded(counters.queue_summary(counters.queue_series(events, SEGMENT)), "mean", "std", "q25", "q50", "q75")


@query(
    "time_blocked_full_queue",
    QUEUE + """, w AS (SELECT *, lead(ts) OVER (PARTITION BY rank, stream ORDER BY ts, delta DESC, index) - ts AS len FROM series),
sp AS (SELECT rank AS r, max(ts) - min(ts) AS span FROM tr GROUP BY rank)
SELECT rank, stream, CAST(coalesce(sum(len), 0) AS BIGINT) AS duration_at_max_queue_length, round(coalesce(sum(len), 0) / max(span), 9) AS relative_duration_at_max_queue_length
FROM w JOIN sp ON rank = r WHERE queue_length >= 2 GROUP BY rank, stream""",
)
def time_blocked_full_queue(events):
    return rounded(counters.time_blocked(events, counters.queue_series(events, SEGMENT), 2), "relative_duration_at_max_queue_length", digits=9)


BANDWIDTH = """, mm AS (SELECT rank, CASE WHEN name LIKE 'Memset%' THEN 'Memset' ELSE substr(name, 1, 11) END AS name, ts, ts + greatest(dur, 1) AS fin, bw FROM tr WHERE stream <> -1 AND (name LIKE 'Memcpy%' OR name LIKE 'Memset%')),
bd AS (SELECT rank, name, ts, sum(delta) AS delta FROM (SELECT rank, name, ts, bw AS delta FROM mm UNION ALL SELECT rank, name, fin, -bw FROM mm) u GROUP BY ALL),
bws AS (SELECT rank, name, ts, round(round(sum(delta) OVER (PARTITION BY rank, name ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0.0, 4) AS memory_bw_gbps FROM bd)"""


@query("memory_bw_series", BANDWIDTH + " SELECT rank, name, ts, CAST(CASE WHEN memory_bw_gbps = 0 THEN 0 ELSE memory_bw_gbps END AS DOUBLE) AS memory_bw_gbps FROM bws")
def memory_bw_series(events):
    series = rounded(counters.bandwidth_series(events, SEGMENT), "memory_bw_gbps", digits=4)
    return series.withColumn("memory_bw_gbps", F.when(F.col("memory_bw_gbps") == 0, 0.0).otherwise(F.col("memory_bw_gbps")))


@query("memory_bw_summary", BANDWIDTH + f" SELECT rank, name, {described('memory_bw_gbps')} FROM bws WHERE memory_bw_gbps > 0 GROUP BY ALL")
def memory_bw_summary(events):
    series = rounded(counters.bandwidth_series(events, SEGMENT), "memory_bw_gbps", digits=4)
    return rounded(counters.bandwidth_summary(series), "mean", "std", "q25", "q50", "q75")


LAUNCH = """, ls AS (SELECT h.rank, h.corr AS correlation, h.dur AS cpu_duration, k.dur AS gpu_duration, greatest(k.ts - h.ts - h.dur, 0) AS launch_delay
 FROM tr h JOIN tr k ON h.rank = k.rank AND h.corr = k.corr WHERE h.name IN ('cudaLaunchKernel', 'cudaMemcpyAsync', 'cudaMemsetAsync') AND k.stream <> -1)"""


@query("kernel_launch_stats", LAUNCH + " SELECT * FROM ls")
def kernel_launch_stats(events):
    return kernels.launch_statistics(events, with_memory=True)


@query(
    "launch_outliers",
    LAUNCH + """ SELECT rank, count(*) FILTER (cpu_duration <= 5000000 AND gpu_duration < cpu_duration) AS short_kernels, count(*) FILTER (cpu_duration > 5000000) AS runtime_outliers,
 count(*) FILTER (launch_delay > 90000000) AS delay_outliers FROM ls GROUP BY rank""",
)
def launch_outliers(events):
    return kernels.launch_outliers(kernels.launch_statistics(events, with_memory=True), 5_000_000, 90_000_000)


@query(
    "aten_op_kernels_delay",
    """, o AS (SELECT * FROM tr WHERE cat = 'cpu_op' AND name LIKE 'aten::%'), h AS (SELECT * FROM tr WHERE cat = 'cuda_runtime' AND corr >= 0),
m AS (SELECT h.rank, h.tid, h.idx, h.corr, h.ts AS lts, arg_max(o.name, (o.ts, o.idx)) AS op, max(o.ts) AS ots FROM h JOIN o ON h.rank = o.rank AND o.ts <= h.ts AND h.ts <= o."end" GROUP BY ALL),
r AS (SELECT m.rank, m.tid, op, ots, string_agg(k.name, ' -> ' ORDER BY lts, m.idx) AS seq, min(lts) AS l1, arg_min(k.ts, (lts, m.idx)) AS k1 FROM m JOIN tr k ON k.rank = m.rank AND k.corr = m.corr AND k.stream <> -1 GROUP BY ALL)
SELECT op AS aten_op_name, seq AS kernel_sequence, count(*) AS occurrence_count, round(avg(l1 - ots), 3) AS avg_aten_op_launch_delay, round(avg(k1 - l1), 3) AS avg_runtime_delay FROM r GROUP BY ALL""",
)
def aten_op_kernels_delay(events):
    return kernels.operator_kernels(events, WIDTH)


def with_annotations(events: DataFrame) -> DataFrame:
    """events with GPU annotations: host operators put on their kernels' stream."""
    ops = events.where("cat = 'cpu_op'")
    marks = ops.select(
        "rank", (F.col("index") + 1_000_000_000).alias("index"), F.lit(7).alias("tid"), F.lit(7).alias("stream"), "ts", (F.col("dur") + 30_000_000).alias("dur"), "name",
        F.lit("gpu_user_annotation").alias("cat"), "correlation", "memory_bw_gbps", "pid", (F.col("end") + 30_000_000).alias("end"),
    )
    return events.unionByName(marks)


@query(
    "kernels_with_annotation",
    """, a AS (SELECT rank, idx + 1000000000 AS idx, 7 AS tid, ts, dur + 30000000 AS dur, "end" + 30000000 AS "end", name FROM tr WHERE cat = 'cpu_op'), k AS (SELECT * FROM tr WHERE stream <> -1)
SELECT k.rank, k.idx AS index, k.name, arg_min(a.name, (a.dur, a.ts, a.idx)) AS user_annotation FROM k LEFT JOIN a ON k.rank = a.rank AND k.tid = a.tid AND a.ts < k."end" AND k.ts < a."end" GROUP BY k.rank, k.idx, k.name""",
)
def kernels_with_annotation(events):
    return kernels.kernels_with_annotation(with_annotations(events), WIDTH).select("rank", "index", "name", "user_annotation")


@query(
    "user_annotation_breakdown",
    f" SELECT rank, name, {STATS} FROM tr WHERE cat = 'user_annotation' GROUP BY rank, name",
)
def user_annotation_breakdown(events):
    return rounded(kernels.annotation_breakdown(events, gpu=False), "mean", "stddev", digits=1)


CORRELATED = """, ic AS (SELECT t.*, CASE WHEN t.corr < 0 THEN -1 ELSE coalesce(p.idx, 0) END AS index_correlation FROM tr t LEFT JOIN tr p ON t.rank = p.rank AND t.corr = p.corr AND t.corr >= 0 AND (t.stream = -1) <> (p.stream = -1))"""


@query("correlation_index", CORRELATED + " SELECT rank, idx AS index, correlation, index_correlation FROM (SELECT *, corr AS correlation FROM ic) q")
def correlation_index(events):
    return silver.with_index_correlation(events).select("rank", "index", "correlation", "index_correlation")


ITERATED = (
    CORRELATED
    + """, it0 AS (SELECT *, CASE WHEN stream = -1 THEN CAST(floor(ts / 86400000000.0) AS BIGINT) END AS own FROM ic),
it AS (SELECT a.*, CAST(coalesce(a.own, b.own, -1) AS INT) AS iteration FROM it0 a LEFT JOIN it0 b ON a.stream > 0 AND b.stream = -1 AND a.rank = b.rank AND a.index_correlation = b.idx)"""
)


def iterated(events):
    return silver.with_iteration(silver.with_index_correlation(events))


@query("iteration_assignment", ITERATED + " SELECT rank, idx AS index, iteration FROM it")
def iteration_assignment(events):
    return iterated(events).select("rank", "index", "iteration")


@query("iterations", ITERATED + " SELECT DISTINCT iteration FROM it WHERE iteration >= 0")
def iterations(events):
    return filters.iterations(iterated(events))


@query("align_ranks", " SELECT rank, idx AS index, ts - (SELECT min(ts) FROM tr) AS ts FROM tr")
def align_ranks(events):
    return silver.align_ranks(events).select("rank", "index", "ts")


@query(
    "trim_last_step",
    """, bo AS (SELECT rank AS br, max(ts) AS bound FROM tr WHERE cat = 'user_annotation' GROUP BY rank), ho AS (SELECT * FROM tr JOIN bo ON rank = br WHERE stream = -1 AND ts < bound)
SELECT rank, idx AS index FROM ho UNION ALL SELECT rank, idx FROM tr WHERE stream <> -1 AND EXISTS (SELECT 1 FROM ho WHERE ho.rank = tr.rank AND ho.corr = tr.corr AND ho.corr >= 0)""",
)
def trim_last_step(events):
    return silver.trim_to_steps(events).select("rank", "index")


KEYS = ["rank", "index"]


@query("filter_time_range", ' SELECT rank, idx AS index FROM tr WHERE ts >= 86400000000 AND "end" <= 259200000000')
def filter_time_range(events):
    return filters.time_range_filter((86_400_000_000, 259_200_000_000))(events).select(*KEYS)


@query("filter_name_regex", " SELECT rank, idx AS index FROM tr WHERE regexp_matches(name, '^(?:aten::(mm|add))')")
def filter_name_regex(events):
    return filters.distinct_name_filter("aten::(mm|add)")(events).select(*KEYS)


@query("filter_iteration", ITERATED + " SELECT rank, idx AS index FROM it WHERE iteration IN (2, 5)")
def filter_iteration(events):
    return filters.iteration_filter([2, 5])(iterated(events)).select(*KEYS)


@query("filter_iteration_index", ITERATED + " SELECT rank, idx AS index FROM it WHERE iteration IN (SELECT DISTINCT iteration FROM it WHERE iteration >= 0 ORDER BY 1 LIMIT 1 OFFSET 3)")
def filter_iteration_index(events):
    return filters.iteration_index_filter(3)(iterated(events)).select(*KEYS)


def anchored(condition: str, name: str = "aten::mm", position: int = 4) -> str:
    return f""", an AS MATERIALIZED (SELECT rank AS ar, stream AS s, ts AS a, "end" AS z FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY ts, idx) AS p FROM tr WHERE name = '{name}') q WHERE p = {position + 1})
SELECT rank, idx AS index FROM tr JOIN an ON rank = ar AND stream = s WHERE {condition}"""


@query("filter_under_operator", anchored('ts >= a AND "end" <= z', "ProfilerStep#4", 0))
def filter_under_operator(events):
    return filters.operator_filter("ProfilerStep#4", 0, "under")(events).select(*KEYS)


@query("filter_after_operator", anchored("ts >= z"))
def filter_after_operator(events):
    return filters.operator_filter("aten::mm", 4, "after")(events).select(*KEYS)


@query("filter_before_operator", anchored('"end" <= a'))
def filter_before_operator(events):
    return filters.operator_filter("aten::mm", 4, "before")(events).select(*KEYS)


@query(
    "filter_combined_operator",
    """, an AS MATERIALIZED (SELECT rank AS ar, ts AS a, "end" AS z FROM tr WHERE name = 'ProfilerStep#4'), un AS (SELECT rank, idx, corr, cat FROM tr JOIN an ON rank = ar WHERE stream = -1 AND ts >= a AND "end" <= z)
SELECT rank, idx AS index FROM un UNION ALL SELECT rank, idx FROM tr WHERE stream <> -1 AND EXISTS (SELECT 1 FROM un WHERE un.rank = tr.rank AND un.corr = tr.corr AND un.cat = 'cuda_runtime')""",
)
def filter_combined_operator(events):
    return filters.combined_operator_filter(root="ProfilerStep#4", following="no such operator", gpu=True)(silver.with_index_correlation(events)).select(*KEYS)


@query("filter_composite", " SELECT rank, idx AS index FROM tr WHERE rank IN (1, 2) AND dur > 0 AND (stream >= 0 AND corr >= 0) AND name = 'Memcpy HtoD (Pageable -> Device)' AND cat = 'gpu_memcpy'")
def filter_composite(events):
    chain = [filters.rank_filter([1, 2]), filters.zero_duration_filter(), filters.gpu_kernel_filter(), filters.memcpy_filter("Memcpy HtoD (Pageable -> Device)")]
    return filters.composite_filter(chain)(events).select(*KEYS)


@query("filter_cpu_operators", " SELECT rank, idx AS index FROM tr WHERE NOT (stream >= 0 AND corr >= 0)")
def filter_cpu_operators(events):
    return filters.cpu_operator_filter()(events).select(*KEYS)


COMPARED = (
    ITERATED
    + """, c1 AS (SELECT name, count(*) AS n, sum(dur) AS d FROM it WHERE rank = 0 AND iteration = 1 GROUP BY name), c2 AS (SELECT name, count(*) AS n, sum(dur) AS d FROM it WHERE rank = 1 AND iteration = 2 GROUP BY name),
cmp AS (SELECT coalesce(c1.name, c2.name) AS name, coalesce(c1.n, 0) AS control_counts, CAST(coalesce(c1.d, 0) AS BIGINT) AS control_total_duration, coalesce(c2.n, 0) AS test_counts, CAST(coalesce(c2.d, 0) AS BIGINT) AS test_total_duration FROM c1 FULL JOIN c2 ON c1.name = c2.name)"""
)


def compared(events):
    rows = iterated(events)
    return compare.compare_traces(compare.extract(rows, 0, 1), compare.extract(rows, 1, 2))


@query(
    "trace_compare",
    COMPARED + """ SELECT *, test_counts - control_counts AS diff_counts, test_total_duration - control_total_duration AS diff_duration,
 CASE WHEN test_counts > control_counts THEN '+' WHEN test_counts < control_counts THEN '-' ELSE '=' END AS counts_change_categories FROM cmp""",
)
def trace_compare(events):
    return compared(events)


@query(
    "ops_diff",
    COMPARED + """ SELECT name, CASE WHEN control_counts = 0 THEN 'added' WHEN test_counts = 0 THEN 'deleted' WHEN test_counts > control_counts THEN 'increased'
 WHEN test_counts < control_counts THEN 'decreased' ELSE 'unchanged' END AS change FROM cmp""",
)
def ops_diff(events):
    return compare.operator_changes(compared(events))


STARTS = (
    ITERATED
    + """, sr AS (SELECT * FROM it WHERE stream > 0 AND iteration > 0), ss AS (SELECT min(ts) AS t0, (max("end") - min(ts)) / count(DISTINCT iteration) AS mean FROM sr),
cs AS (SELECT * FROM sr, ss WHERE name LIKE 'ncclKernel%' AND dur >= 0.0001 * mean),
st AS (SELECT rank, stream, iteration, name, (arg_max(ts, idx) - max(t0)) / max(mean) AS start FROM cs GROUP BY rank, stream, iteration, name),
sm AS (SELECT stream, name, avg(std) AS spread FROM (SELECT stream, name, iteration, stddev_samp(start) AS std FROM st GROUP BY ALL) q GROUP BY ALL)"""
)


def starts(events):
    return compare.communication_starts(iterated(events), least_share=0.0001)


@query("straggler_metric", STARTS + " SELECT stream, name, round(spread, 6) AS spread FROM sm")
def straggler_metric(events):
    return rounded(compare.straggler_metric(starts(events)), "spread", digits=6)


@query(
    "straggler_topk",
    STARTS + """, ch AS (SELECT stream AS cs_, name AS cn_ FROM sm ORDER BY spread DESC, stream, name DESC LIMIT 1),
pl AS (SELECT rank, rank() OVER (PARTITION BY iteration ORDER BY start DESC) AS place FROM st JOIN ch ON stream = cs_ AND name = cn_)
SELECT rank, count(*) AS times FROM pl WHERE place <= 2 GROUP BY rank ORDER BY times DESC, rank LIMIT 2""",
)
def straggler_topk(events):
    return compare.stragglers(starts(events), 2)


@query(
    "anomaly_zscore",
    """, s AS (SELECT rank, name, avg(dur) AS value FROM tr GROUP BY ALL), w AS (SELECT *, avg(value) OVER (PARTITION BY name) AS mean, greatest(stddev_samp(value) OVER (PARTITION BY name), 0.1) AS std, count(*) OVER (PARTITION BY name) AS n FROM s)
SELECT rank, name, round(value, 3) AS value, round((value - mean) / std, 6) AS z_score, n > 1 AND (abs((value - mean) / std) > 1.2 OR coalesce(abs(value - mean) / nullif(abs(mean), 0), 0) > 0.5) AS is_anomaly FROM w""",
)
def anomaly_zscore(events):
    means = events.groupBy("rank", "name").agg(F.avg("dur").alias("value"))
    out = compare.anomalies(means, ["name"], "value", z=1.2)
    return rounded(rounded(out, "value"), "z_score", digits=6).select("rank", "name", "value", "z_score", "is_anomaly")


@query("profiler_steps", " SELECT DISTINCT CAST(regexp_extract(name, '^ProfilerStep#(\\d+)', 1) AS BIGINT) AS step FROM tr WHERE cat = 'user_annotation'")
def profiler_steps(events):
    return compare.profiler_steps(events)


@query(
    "cuda_event_asof_prev",
    """, v AS (SELECT rank, ts, idx, name FROM tr WHERE cat = 'cuda_runtime'), p AS (SELECT rank, ts, idx FROM tr WHERE cat = 'cpu_op')
SELECT p.rank, p.idx AS index, v.idx AS v_index, v.name AS v_name FROM p ASOF LEFT JOIN v ON p.rank = v.rank AND p.ts >= v.ts""",
)
def cuda_event_asof_prev(events):
    points = events.where("cat = 'cpu_op'").select("rank", "ts", F.col("index").alias("index"))
    values = events.where("cat = 'cuda_runtime'").select("rank", "ts", "index", "name")
    return intervals.asof_backward(points, values, ["rank"], ["ts"], ["index", "name"]).select("rank", "index", "v_index", "v_name")


@query(
    "stream_wait_asof_next",
    """, v AS (SELECT rank, ts, idx FROM tr WHERE cat = 'cuda_runtime'), p AS (SELECT rank, ts, idx FROM tr WHERE cat = 'user_annotation')
SELECT p.rank, p.idx AS index, v.idx AS v_index FROM p ASOF LEFT JOIN v ON p.rank = v.rank AND p.ts < v.ts""",
)
def stream_wait_asof_next(events):
    points = events.where("cat = 'user_annotation'").select("rank", "ts", "index")
    values = events.where("cat = 'cuda_runtime'").select("rank", "ts", "index")
    return intervals.asof_forward(points, values, ["rank"], ["ts"], ["index"]).select("rank", "index", "v_index")


@query("short_names", " SELECT DISTINCT name, CASE name WHEN 'void gemm_kernel<float>(int)' THEN 'gemm_kernel' ELSE name END AS short_name FROM tr")
def short_names(events):
    return N.short_names(events.select("name").distinct())


@query("device_type_by_rank", ", x AS (SELECT * FROM tr WHERE rank > 0) SELECT rank, stream, CASE WHEN stream > 0 THEN 'GPU' ELSE 'CPU' END AS device_type FROM x GROUP BY rank, stream")
def device_type_by_rank(events):
    return N.device_type(events.where("rank > 0"), "rank", "stream", zero_ids=False)


@query("trace_duration", " SELECT rank, max(ts) - min(ts) AS duration FROM tr GROUP BY rank")
def trace_duration(events):
    return events.groupBy("rank").agg((F.max("ts") - F.min("ts")).alias("duration"))


@query("symbols", ", s AS (SELECT name FROM tr UNION SELECT cat FROM tr) SELECT row_number() OVER (ORDER BY name) - 1 AS sym_id, name AS symbol FROM s")
def symbols(events):
    return silver.symbols(events)


ENCLOSED = """, cp AS (SELECT rank, idx, ts, "end", name, dur, corr, cat FROM tr WHERE stream = -1),
pr AS (SELECT a.rank, a.idx, a.corr, b.idx AS anc, b.ts AS bts, b.dur AS bdur, b.cat AS bcat FROM cp a JOIN cp b ON a.rank = b.rank AND ((a.idx = b.idx) OR (b.ts <= a.ts AND a."end" <= b."end" AND b.cat < a.cat AND b.cat = 'user_annotation')
  OR (b.cat = 'user_annotation' AND a.cat <> 'user_annotation' AND b.ts <= a.ts AND a."end" <= b."end") OR (b.cat = 'cpu_op' AND a.cat = 'cuda_runtime' AND b.idx = a.idx - 1)))"""


@query(
    "call_stack_parent_depth",
    ENCLOSED + """ SELECT rank, idx AS index, coalesce(arg_max(anc, CASE bcat WHEN 'cpu_op' THEN 2 ELSE 1 END) FILTER (anc <> idx), -1) AS parent, count(DISTINCT anc) - 1 AS depth FROM pr GROUP BY rank, idx""",
)
def call_stack_parent_depth(events):
    return callstack.call_stacks(events, SEGMENT).select("rank", "index", "parent", "depth")


def with_pairs(events):
    return silver.with_index_correlation(events), callstack.closure(kept(callstack.starts_with_depth(events, SEGMENT)))


@query(
    "call_stack_kernel_rollup",
    ENCLOSED + """, kd AS (SELECT DISTINCT pr.rank, pr.anc, k.idx, k.ts, k.dur, k."end" FROM pr JOIN tr k ON k.rank = pr.rank AND k.corr = pr.corr AND k.stream <> -1 WHERE pr.corr >= 0)
SELECT rank, anc AS index, count(*) AS num_kernels, sum(dur) AS kernel_dur_sum, min(ts) AS first_kernel_start, max("end") AS last_kernel_end, max("end") - min(ts) AS kernel_span FROM kd GROUP BY rank, anc""",
)
def call_stack_kernel_rollup(events):
    return callstack.kernel_rollup(*with_pairs(events))


@query(
    "op_stack_paths",
    ENCLOSED + """ SELECT rank, idx AS index, string_agg(CAST(anc AS VARCHAR), '/' ORDER BY CASE WHEN anc = idx THEN 3 WHEN bcat = 'cpu_op' THEN 2 ELSE 1 END) AS path FROM (SELECT DISTINCT rank, idx, anc, bcat FROM pr) q GROUP BY rank, idx""",
)
def op_stack_paths(events):
    found = callstack.paths(callstack.closure(callstack.starts_with_depth(events, SEGMENT)))
    return found.select("rank", "index", F.array_join("path", "/").alias("path"))


@query(
    "frequent_kernel_sequences",
    """, o AS (SELECT * FROM tr WHERE cat = 'cpu_op' AND contains(name, 'aten')), h AS (SELECT * FROM tr WHERE cat = 'cuda_runtime'),
x AS (SELECT o.name || '|' || k.name AS pattern, k.dur AS kd, o.dur AS od FROM o JOIN h ON h.rank = o.rank AND h.idx = o.idx + 1 JOIN tr k ON k.rank = h.rank AND k.corr = h.corr AND k.stream <> -1)
SELECT pattern, count(*) AS count, sum(kd) AS kernel_duration, sum(od) AS op_duration FROM x GROUP BY pattern ORDER BY count DESC, pattern LIMIT 5""",
)
def frequent_kernel_sequences(events):
    rows, pairs = with_pairs(events)
    return callstack.frequent_sequences(rows, pairs, "aten", least=1)


def plain_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) with SQL of its own."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


SIZES = {"tp": 2, "ep": 2, "dp": 3, "pp": 4}


@plain_query(
    "rank_groups",
    """WITH r AS (SELECT CAST(k AS INT) AS rank, k % 2 AS tp, k // 2 % 2 AS ep, k // 4 % 3 AS dp, k // 12 % 4 AS pp FROM range(48) t(k))
SELECT x.*, n FROM (SELECT 'pp' AS token, CAST(tp + 2 * ep + 4 * dp AS INT) AS group_id, CAST(pp AS INT) AS pos, rank FROM r UNION ALL SELECT 'tp-dp', CAST(ep + 2 * pp AS INT), CAST(tp + 2 * dp AS INT), rank FROM r) x JOIN (""" + ON(48) + ") ON rank = on_",
)
def rank_groups(spark, sf_dir):
    return parallel.rank_groups(spark, SIZES, "pp").unionByName(parallel.rank_groups(spark, SIZES, "tp-dp")).join(events_on(spark, sf_dir, 48, "rank"), "rank")


@plain_query(
    "rank_neighbours",
    """WITH r AS (SELECT CAST(k AS INT) AS rank, CAST(k % 12 AS INT) AS group_id, CAST(k // 12 AS INT) AS pos FROM range(48) t(k))
SELECT group_id, rank, CAST((rank + 36) % 48 AS INT) AS prev_rank, CAST((rank + 12) % 48 AS INT) AS next_rank, pos = 0 AS is_first, pos = 3 AS is_last, n FROM r JOIN (""" + ON(48) + ") ON rank = on_",
)
def rank_neighbours(spark, sf_dir):
    return parallel.neighbours(parallel.rank_groups(spark, SIZES, "pp")).select("group_id", "rank", "prev_rank", "next_rank", "is_first", "is_last").join(events_on(spark, sf_dir, 48, "rank"), "rank")


@plain_query(
    "pp_schedule_table",
    """WITH t AS (SELECT k AS position, k // 8 AS block, least(4, 10 - 4 * (k // 8)) AS width, k % 8 AS inside FROM range(20) t(k)),
s AS (SELECT position, CAST(block * 4 + inside % width AS BIGINT) AS micro_batch, CAST(inside // width AS BIGINT) AS chunk FROM t)
SELECT x.*, n FROM (SELECT CASE WHEN position < 5 THEN position ELSE 5 + 2 * (position - 5) END AS step, 'forward' AS direction, micro_batch, chunk FROM s
UNION ALL SELECT CASE WHEN position < 15 THEN 5 + 2 * position + 1 ELSE 20 + position END, 'backward', micro_batch, 1 - chunk FROM s) x JOIN (""" + ON(40) + ") ON step = on_",
)
def pp_schedule_table(spark, sf_dir):
    return parallel.schedule_order(parallel.schedule_table(spark, 10, 2, 4), 5).join(events_on(spark, sf_dir, 40, "step"), "step")


@plain_query("pp_warmup", "SELECT CAST(k AS INT) AS stage, CAST(least((4 - k - 1) * 2 + 4, 16) AS INT) AS interleaved, CAST(least(4 - k - 1, 8) AS INT) AS plain, n FROM (SELECT on_ AS k, n FROM (" + ON(4) + "))")
def pp_warmup(spark, sf_dir):
    stage, four = F.col("stage"), F.lit(4)
    return events_on(spark, sf_dir, 4, "stage").select("stage", "n", parallel.warmup(four, stage, F.lit(8), F.lit(2), four).alias("interleaved"), parallel.warmup(four, stage, F.lit(8)).alias("plain"))


@plain_query("p2p_link", f'WITH {TRANSFERS} SELECT "group", rank, name, index, comm_time, wait FROM linked')
def p2p_link(spark, sf_dir):
    return parallel.link_transfers(parallel.micro_batch_ids(transfers(spark, sf_dir))).select("group", "rank", "name", "index", "comm_time", "wait")


@plain_query(
    "schedule_steps",
    f"""WITH {TRANSFERS} SELECT "group", 'interleaved' AS schedule, name, count(*) AS n FROM linked WHERE name IN ('forward_step', 'backward_step') GROUP BY ALL
UNION ALL SELECT "group", '1f1b', name, count(*) FROM linked WHERE name <> 'optimizer_step' GROUP BY ALL""",
)
def schedule_steps(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    kept = [rows.where(N.is_schedule_step(F.col("name"), s)).groupBy("group", F.lit(s).alias("schedule"), "name").agg(F.count("*").alias("n")) for s in ("interleaved", "1f1b")]
    return kept[0].unionByName(kept[1])


@plain_query(
    "bubble_report_1f1b",
    f"""WITH {TRANSFERS}, o AS (SELECT "group" AS og, min(ts) AS opt FROM linked WHERE stage = 0 AND name = 'optimizer_step' GROUP BY "group"),
p AS (SELECT "group", rank, stage, arg_min(wait, ts) FILTER (name = 'recv_forward') AS w, coalesce(sum(wait) FILTER (name IN ('recv_forward', 'send_forward')), 0) AS warm,
 coalesce(sum(wait) FILTER (name IN ('send_backward', 'recv_backward')), 0) AS cool, max(ts + dur) FILTER (name IN ('backward_step', 'send_backward', 'recv_backward')) AS fin, sum(comm_time) AS comm FROM linked GROUP BY ALL)
SELECT "group", rank, stage, CASE stage WHEN 0 THEN 0 ELSE w END / 1000.0 AS warmup_theoretical, warm / 1000.0 AS warmup_total, (warm - CASE stage WHEN 0 THEN 0 ELSE w END) / 1000.0 AS warmup_non_balanced,
 0.0 AS steady_theoretical, 0.0 AS steady_total, 0.0 AS steady_non_balanced, (CASE stage WHEN 3 THEN 0 ELSE cool END + greatest(opt - fin, 0)) / 1000.0 AS cooldown_theoretical, 0.0 AS cooldown_extra,
 comm / 1000.0 AS comm_total, CAST(3.0 / 11 AS DOUBLE) AS ideal_bubble_ratio FROM p JOIN o ON "group" = og""",
)
def bubble_report_1f1b(spark, sf_dir):
    return parallel.bubble_report_1f1b(parallel.link_transfers(parallel.micro_batch_ids(transfers(spark, sf_dir))), STAGES, MICRO_BATCHES)


IDLE = f"""{ANNOTATED}, gp AS (SELECT *, fks - lag(fks + span) OVER (PARTITION BY "group", rank ORDER BY fks, ts) AS gap FROM annotated WHERE num_kernels > 0),
fr AS (SELECT "group" AS g, rank AS r, arg_min(dur, ts) AS wait FROM annotated WHERE name = 'recv_forward' GROUP BY ALL),
i0 AS (SELECT *, row_number() OVER (PARTITION BY "group", rank ORDER BY fks, ts) AS p FROM gp WHERE name IN ('forward_step', 'backward_step')),
i AS (SELECT i0.*, split_part(name, '_', 1) AS direction, CASE p WHEN 1 THEN coalesce(wait, 0) ELSE gap END AS idle FROM i0 LEFT JOIN fr ON "group" = g AND rank = r)"""


@plain_query("idle_intervals", f'WITH {IDLE} SELECT "group", rank, direction, ts, idle FROM i')
def idle_intervals(spark, sf_dir):
    return parallel.idle_intervals(annotated(spark, sf_dir)).select("group", "rank", "direction", "ts", "idle")


@plain_query(
    "bubble_report_interleaved",
    f"""WITH {IDLE}, k AS (SELECT *, row_number() OVER (PARTITION BY "group", rank, direction ORDER BY ts) AS k, (4 - rank - 1) * 2 + 4 AS w FROM i),
f AS (SELECT *, direction = 'forward' AS fw, direction = 'backward' AND k > 16 - w AS cool FROM k)
SELECT "group", rank, stage, coalesce(sum(idle) FILTER (rank > 0 AND fw AND k = 1), 0) / 1000.0 AS warmup_theoretical, coalesce(sum(idle) FILTER (fw AND k <= w + 1), 0) / 1000.0 AS warmup_total,
 coalesce(sum(idle) FILTER (rank < 3 AND NOT fw AND k = 1), 0) / 1000.0 AS steady_theoretical, coalesce(sum(idle) FILTER ((fw AND k > w + 1) OR (NOT fw AND NOT cool)), 0) / 1000.0 AS steady_total,
 coalesce(sum(idle) FILTER (cool AND k - (16 - w) <= (4 - rank - 1) * 2), 0) / 1000.0 AS cooldown_theoretical, coalesce(sum(idle) FILTER (cool AND k - (16 - w) > (4 - rank - 1) * 2), 0) / 1000.0 AS cooldown_extra,
 sum(idle) / 1000.0 AS comm_total, CAST({(STAGES - 1) / MICRO_BATCHES / VIRTUAL} AS DOUBLE) AS ideal_bubble_ratio
FROM f GROUP BY "group", rank, stage""",
)
def bubble_report_interleaved(spark, sf_dir):
    return parallel.bubble_report_interleaved(parallel.idle_intervals(annotated(spark, sf_dir)), STAGES, VIRTUAL, MICRO_BATCHES, 4)


@plain_query(
    "device_timeline",
    f"""WITH {ANNOTATED} SELECT "group", rank, split_part(name, '_', 1) AS direction, ts // 1000000 AS micro_batch, min(fks) AS start, max(fks + span) AS "end", count(*) AS rows
FROM annotated WHERE num_kernels > 0 AND fks > 0 AND name LIKE '%step' GROUP BY ALL""",
)
def device_timeline(spark, sf_dir):
    rows = annotated(spark, sf_dir).where("name like '%step'").withColumns({"direction": F.substring_index("name", "_", 1), "last_kernel_end": F.col("first_kernel_start") + F.col("kernel_span")})
    merged_steps = parallel.device_timeline(rows.withColumns({"micro_batch": F.floor(F.col("ts") / 1_000_000), "stage": F.lit(0)}))
    return merged_steps.drop("stage")


@plain_query("align_groups", f'WITH {ANNOTATED} SELECT "group", rank, name, ts - min(ts) FILTER (num_kernels > 0) OVER (PARTITION BY "group") AS ts FROM annotated')
def align_groups(spark, sf_dir):
    return parallel.align_groups(annotated(spark, sf_dir)).select("group", "rank", "name", "ts")


@plain_query(
    "phase_times",
    f"""WITH {ANNOTATED} SELECT "group", rank, arg_min(dur, ts) FILTER (name = 'forward_step') / 1000.0 AS forward_step, arg_min(dur, ts) FILTER (name = 'recv_backward') / 1000.0 AS recv_backward FROM annotated GROUP BY ALL""",
)
def phase_times(spark, sf_dir):
    return parallel.phase_times(annotated(spark, sf_dir), ("forward_step", "recv_backward"))


@plain_query(
    "step_names",
    f"""WITH {STEPS} SELECT rank, direction || '_mb' || micro_batch || '_vpp' || stage AS name, direction AS without_index, direction || '_mb' || micro_batch AS without_stage, count(*) AS n FROM steps GROUP BY ALL""",
)
def step_names(spark, sf_dir):
    named = steps(spark, sf_dir).withColumn("name", N.step_name(F.col("direction"), F.col("micro_batch"), F.col("stage")))
    named = named.withColumns({"without_index": N.without_index(F.col("name")), "without_stage": F.regexp_replace("name", r"_vpp\d+$", "")})
    return named.groupBy("rank", "name", "without_index", "without_stage").agg(F.count("*").alias("n"))


@query("step_spans_from", """, k AS (SELECT *, row_number() OVER (PARTITION BY rank, name LIKE 'ProfilerStep%' ORDER BY ts, idx) AS p FROM tr),
s AS (SELECT rank AS r, ts AS s_ts, dur AS s_dur, row_number() OVER (PARTITION BY rank ORDER BY ts, idx) AS q FROM tr WHERE name = 'aten::mm')
SELECT rank, idx AS index, coalesce(s_ts, ts) AS ts, coalesce(s_dur, dur) AS dur FROM k LEFT JOIN s ON rank = r AND p = q AND name LIKE 'ProfilerStep%'""")
def step_spans_from(events):
    return parallel.step_spans_from(events, "aten::mm").select("rank", "index", "ts", "dur")


@query("filter_first_iteration", ITERATED + " SELECT rank, idx AS index FROM it WHERE iteration = (SELECT min(iteration) FROM it WHERE iteration >= 0)")
def filter_first_iteration(events):
    return filters.first_iteration_filter()(iterated(events)).select(*KEYS)


@query(
    "names_by_patterns",
    " SELECT rank, idx AS index, contains(name, 'mm') OR contains(name, 'Memcpy') AS contained, starts_with(name, 'aten::a') OR starts_with(name, 'cuda') AS started, cat IN ('cpu_op', 'cuda_runtime', 'cuda_driver') AS host FROM tr",
)
def names_by_patterns(events):
    found = {"contained": N.names_contain(["mm", "Memcpy"]), "started": N.names_start_like(["aten::a", "cuda"]), "host": N.is_operator_or_runtime()}
    return events.select("rank", "index", *[c.alias(k) for k, c in found.items()])


@query(
    "stack_labels",
    """, h AS (SELECT rank, tid, CASE WHEN bool_or(name LIKE 'ProfilerStep%') THEN 'main' ELSE 'other' END AS label FROM (SELECT rank, CASE WHEN cat = 'cuda_runtime' THEN idx % 3 + 1 ELSE 0 END AS tid, name FROM tr WHERE stream = -1) GROUP BY ALL)
SELECT rank, CAST(tid AS INT) AS tid, label, row_number() OVER (PARTITION BY rank, label ORDER BY tid) - 1 AS number FROM h""",
)
def stack_labels(events):
    threads = events.withColumn("tid", F.when(F.col("cat") == "cuda_runtime", F.col("index") % 3 + 1).otherwise(0).cast("int"))
    return callstack.stack_labels(threads).select("rank", "tid", "label", "number")


@query(
    "execution_trace_columns",
    """, n AS (SELECT rank AS r, idx // 2 AS rf, max(name) AS et_name FROM tr WHERE stream = -1 AND idx >= 0 AND idx % 2 = 0 GROUP BY ALL)
SELECT rank, idx AS index, et_name FROM tr LEFT JOIN n ON rank = r AND idx = rf""",
)
def execution_trace_columns(events):
    nodes = events.where("stream = -1 and index >= 0 and index % 2 = 0").groupBy("rank", F.floor(F.col("index") / 2).alias("rf_id")).agg(F.max("name").alias("et_name"))
    return drilldown.join_execution_trace(events.withColumn("external_id", F.col("index")), nodes, ["et_name"]).select("rank", "index", "et_name")


@query(
    "trimmed_children",
    """, p AS (SELECT rank, idx, ts, "end", CASE WHEN idx >= 0 AND idx % 3 = 2 THEN idx - 1 WHEN idx % 3 = 1 THEN idx - 1 END AS up FROM tr WHERE idx >= 0)
SELECT a.rank, a.idx AS index, greatest(least(a."end", coalesce(b."end", a."end"), coalesce(c."end", a."end")) - a.ts, 0) AS dur FROM p a LEFT JOIN p b ON a.rank = b.rank AND a.up = b.idx LEFT JOIN p c ON b.rank = c.rank AND b.up = c.idx""",
)
def trimmed_children(events):
    rows = events.where("index >= 0").select("rank", F.lit(0).alias("tid"), F.col("index").alias("python_id"), F.when(F.col("index") % 3 > 0, F.col("index") - 1).alias("python_parent_id"), "ts", "dur")
    return drilldown.trim_children(rows).select("rank", F.col("python_id").alias("index"), "dur")


@query(
    "overlapping_transfers",
    GPU + """, m AS (SELECT * FROM gpu WHERE name LIKE 'Mem%'), n AS (SELECT * FROM gpu WHERE kernel_type = 'COMMUNICATION')
SELECT m.rank, m.idx AS index, n.idx AS other FROM m LEFT JOIN n ON m.rank = n.rank AND n.ts < m."end" AND m.ts < n."end" """,
)
def overlapping_transfers(events):
    rows = kernels.gpu_rows(events)
    part = lambda where: rows.where(where).select("rank", "index", "ts", "end")
    met = intervals.overlap_join(part("name like 'Mem%'"), part("kernel_type = 'COMMUNICATION'"), ["rank"], WIDTH, "left")
    return met.select("rank", "index", F.col("r_index").alias("other"))


@plain_query(
    "ep_group_stats",
    f"""WITH {STEPS} SELECT CAST(rank % 2 AS INT) AS group_id, micro_batch, direction || '_vpp' || (stage - 1) AS event, min(ts) / 1000.0 AS start_min, max(ts) / 1000.0 AS start_max, min(dur) / 1000.0 AS dur_min,
 max(dur) / 1000.0 AS dur_max, avg(dur) / 1000.0 AS dur_mean, round(stddev_pop(dur) / 1000.0, 6) AS dur_std, count(DISTINCT rank) AS ranks FROM steps GROUP BY ALL""",
)
def ep_group_stats(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("event", F.concat(F.col("direction"), F.lit("_vpp"), (F.col("stage") - 1).cast("string")))
    return rounded(parallel.expert_statistics(rows, parallel.rank_groups(spark, {"tp": 2, "ep": 2}, "ep")), "dur_std", digits=6)


@plain_query("ep_pp_bundles", "SELECT CAST(g AS INT) AS ep_group, [CAST(g % 2 + 4 * (g // 2 % 3) AS INT), CAST(g % 2 + 4 * (g // 2 % 3) + 2 AS INT)] AS pp_groups, n FROM (SELECT on_ AS g, n FROM (" + ON(24) + "))")
def ep_pp_bundles(spark, sf_dir):
    return parallel.bundles(parallel.rank_groups(spark, SIZES, "ep"), parallel.rank_groups(spark, SIZES, "pp")).join(events_on(spark, sf_dir, 24, "ep_group"), "ep_group")


DAG = f"""{STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY ts, rank, direction, micro_batch, stage) AS node FROM steps),
ed AS (SELECT "group", node AS b, lag(node) OVER (PARTITION BY "group", rank ORDER BY ts, node) AS a, 'local' AS kind FROM n
 UNION ALL SELECT s."group", t.node, s.node, CASE WHEN s.rank < 3 THEN 'forward' ELSE 'forward_wrap' END FROM n s JOIN n t ON s."group" = t."group" AND s.direction = 'forward' AND t.direction = 'forward' AND s.micro_batch = t.micro_batch
   AND ((s.rank < 3 AND t.rank = s.rank + 1 AND t.stage = s.stage) OR (s.rank = 3 AND t.rank = 0 AND t.stage = s.stage + 1))
 UNION ALL SELECT s."group", t.node, s.node, CASE WHEN s.rank > 0 THEN 'backward' ELSE 'backward_wrap' END FROM n s JOIN n t ON s."group" = t."group" AND s.direction = 'backward' AND t.direction = 'backward' AND s.micro_batch = t.micro_batch
   AND ((s.rank > 0 AND t.rank = s.rank - 1 AND t.stage = s.stage) OR (s.rank = 0 AND t.rank = 3 AND t.stage = s.stage - 1))
 UNION ALL SELECT s."group", t.node, s.node, 'activation' FROM n s JOIN n t ON s."group" = t."group" AND s.direction = 'forward' AND t.direction = 'backward' AND s.rank = t.rank AND s.micro_batch = t.micro_batch AND s.stage = t.stage),
edges AS (SELECT * FROM ed WHERE a IS NOT NULL)"""


def schedule(spark, sf_dir):
    nodes = dag.schedule_nodes(steps(spark, sf_dir))
    return nodes, dag.schedule_edges(nodes, STAGES, VIRTUAL)


@plain_query("pp_dag_edges", f'WITH {DAG} SELECT "group", a, b, kind FROM edges')
def pp_dag_edges(spark, sf_dir):
    return schedule(spark, sf_dir)[1].select("group", "a", "b", "kind")


@plain_query("pp_dag_violations", f'WITH {DAG} SELECT e."group", a, b, kind, t.ts - s.ts - s.dur AS gap FROM edges e JOIN n s ON a = s.node AND s."group" = e."group" JOIN n t ON b = t.node AND t."group" = e."group" WHERE t.ts - s.ts - s.dur < 0')
def pp_dag_violations(spark, sf_dir):
    return dag.violations(*schedule(spark, sf_dir)).select("group", "a", "b", "kind", "gap")


REACH = f"""WITH RECURSIVE {DAG}, far(g, node, t) USING KEY (g, node) AS (
  SELECT "group", node, dur FROM n UNION SELECT e."group", e.b, max(f.t) + any_value(d.dur) FROM far f JOIN edges e ON e."group" = f.g AND e.a = f.node JOIN n d ON d."group" = e."group" AND d.node = e.b
  JOIN recurring.far o ON o.g = e."group" AND o.node = e.b GROUP BY e."group", e.b HAVING max(f.t) + any_value(d.dur) > max(o.t))"""


@plain_query("pp_dag_total_time", REACH + ' SELECT g AS "group", max(t) AS total FROM far GROUP BY g')
def pp_dag_total_time(spark, sf_dir):
    return pp_dag_longest_path(spark, sf_dir).groupBy("group").agg(F.max("reached").alias("total"))


@plain_query(
    "pp_dag_longest_path",
    REACH + """, come AS (SELECT e."group" AS g, e.b, min(e.a) AS a FROM edges e JOIN far x ON x.g = e."group" AND x.node = e.a JOIN far y ON y.g = e."group" AND y.node = e.b JOIN n d ON d."group" = e."group" AND d.node = e.b WHERE x.t + d.dur = y.t GROUP BY ALL),
path AS (SELECT g, min(node) AS node, CAST(0 AS BIGINT) AS back FROM far f WHERE t = (SELECT max(t) FROM far o WHERE o.g = f.g) GROUP BY g UNION ALL SELECT p.g, c.a, p.back + 1 FROM path p JOIN come c ON c.g = p.g AND c.b = p.node)
SELECT p.g AS "group", p.node, max(back) OVER (PARTITION BY p.g) - back AS position, f.t AS reached FROM path p JOIN far f ON f.g = p.g AND f.node = p.node""",
)
def pp_dag_longest_path(spark, sf_dir):
    nodes, edges = schedule(spark, sf_dir)
    return dag.longest_path(nodes.withColumn("weight", F.col("dur")), edges.withColumn("weight", F.lit(0).cast("long")), "group").select("group", "node", "position", "reached")


@plain_query("gemm_tflops", "SELECT l_quantity AS m, round(2.0 * l_quantity * 128 * 64 / (l_linenumber * 10) / 1e6, 9) AS tflops, round((l_quantity * 64 + 64 * 128 + l_quantity * 128) * 2.0 / (l_linenumber * 10) / 1e3, 9) AS gbps FROM lineitem")
def gemm_tflops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    work = N.gemm_work(F.col("l_quantity"), F.lit(128), F.lit(64), F.col("l_linenumber") * 10, F.lit("half"))
    return rounded(rows.select(F.col("l_quantity").alias("m"), work.alias("w")).select("m", "w.tflops", "w.gbps"), "tflops", "gbps", digits=9)


@query(
    "memory_timeline",
    """, a AS (SELECT ts AS t, dur AS b, CAST(idx % 3 AS INT) AS c, CASE WHEN stream = -1 THEN 1 ELSE -1 END AS s FROM tr WHERE idx >= 0 AND ts > 0),
w AS (SELECT t, sum(CASE WHEN c = 0 THEN s * b ELSE 0 END) AS x, sum(CASE WHEN c = 1 THEN s * b ELSE 0 END) AS y, sum(CASE WHEN c = 2 THEN s * b ELSE 0 END) AS z FROM a GROUP BY t)
SELECT t, [CAST(sum(x) OVER (ORDER BY t) AS BIGINT), CAST(sum(y) OVER (ORDER BY t) AS BIGINT), CAST(sum(z) OVER (ORDER BY t) AS BIGINT)] AS sizes FROM w""",
)
def memory_timeline(events):
    rows = events.where("index >= 0 and ts > 0").select(
        F.col("ts").alias("t"), F.when(F.col("stream") == -1, "create").otherwise("destroy").alias("action"), F.col("dur").alias("numbytes"), (F.col("index") % 3).cast("int").alias("category")
    )
    return counters.memory_timeline(rows, 3)


def clipped(events):
    return critical_path.clip(silver.with_index_correlation(events), "ProfilerStep", 2)


CLIPPED = CORRELATED + """, cw AS (SELECT rank AS wr, ts AS a, "end" AS z FROM tr WHERE name = 'ProfilerStep#2'), ch AS (SELECT ic.* FROM ic JOIN cw ON rank = wr WHERE stream = -1 AND ts >= a AND ts <= z AND dur > 0),
cd AS (SELECT * FROM ic WHERE stream <> -1 AND EXISTS (SELECT 1 FROM ch WHERE ch.rank = ic.rank AND ch.corr = ic.corr AND ch.corr >= 0))"""


@query(
    "critical_path_nodes",
    CLIPPED + """, u AS (SELECT * FROM ch WHERE cat IN ('cpu_op', 'cuda_runtime') UNION ALL SELECT * FROM cd)
SELECT rank, idx AS index, 2 * idx AS node, true AS is_start, ts FROM u UNION ALL SELECT rank, idx, 2 * idx + 1, false, "end" FROM u""",
)
def critical_path_nodes(events):
    return critical_path.nodes(clipped(events))


@query(
    "runtime_lock_edges",
    """, lc AS (SELECT rank, idx, ts, 20 * dur AS dur FROM tr WHERE name IN ('cudaLaunchKernel', 'cudaMemcpyAsync')),
pt AS (SELECT rank, idx, dur, ts AS moment, 1 AS starts FROM lc UNION ALL SELECT rank, idx, dur, ts + dur, 0 FROM lc),
sq AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY moment, idx, starts DESC) AS p FROM pt),
nx AS (SELECT *, lead(idx) OVER w AS nidx, lead(starts) OVER w AS nstarts, min(CASE WHEN starts = 0 THEN p END) OVER (PARTITION BY rank ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ep FROM sq WINDOW w AS (PARTITION BY rank ORDER BY p))
SELECT s.rank, 2 * s.idx AS a, 2 * e.idx + 1 AS b, CASE WHEN s.idx = e.idx THEN 'operator_kernel' ELSE 'dependency' END AS kind, CASE WHEN s.idx = e.idx THEN s.dur ELSE 0 END AS dur
FROM nx s JOIN sq e ON e.rank = s.rank AND e.p = s.ep WHERE s.starts = 1
UNION ALL SELECT rank, 2 * idx + 1, 2 * nidx + 1, 'dependency', 0 FROM nx WHERE starts = 0 AND nstarts = 0""",
)
def runtime_lock_edges(events):
    return critical_path.lock_edges(events.withColumn("dur", 20 * F.col("dur"))).select("rank", "a", "b", "kind", "dur")


@query("kernel_breakdown_by_type", GPU + f" SELECT rank, kernel_type, name, {STATS} FROM gpu GROUP BY ALL")
def kernel_breakdown_by_type(events):
    return rounded(kernels.kernel_breakdown(events), "mean", "stddev", digits=1)


@query("memory_kernel_types", " SELECT CASE WHEN name LIKE 'Memset%' THEN 'Memset' WHEN name LIKE 'Memcpy%' THEN substr(name, 1, 11) ELSE 'Memcpy Unknown' END AS kind, count(*) AS n FROM tr WHERE stream <> -1 GROUP BY 1")
def memory_kernel_types(events):
    return events.where(N.is_gpu_stream()).groupBy(N.memory_kernel_type(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@query("find_occurrence", ", o AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY ts DESC, idx DESC) AS p FROM tr WHERE name = 'aten::add') SELECT rank, idx AS index FROM o WHERE p = 2")
def find_occurrence(events):
    return filters.find_occurrence(events, "aten::add", -2).select(*KEYS)


@query("matching_kernels", " SELECT k.rank, k.idx AS index FROM tr k WHERE k.stream <> -1 AND EXISTS (SELECT 1 FROM tr h WHERE h.rank = k.rank AND h.corr = k.corr AND h.name = 'cudaMemcpyAsync')")
def matching_kernels(events):
    rows = silver.with_index_correlation(events)
    return filters.matching_kernels(rows.where("name = 'cudaMemcpyAsync'"), rows).select(*KEYS)


@query(
    "backward_links",
    """, a AS (SELECT rank, idx, ts, row_number() OVER (PARTITION BY rank ORDER BY ts, idx) AS p FROM tr WHERE cat = 'cpu_op'), s AS (SELECT * FROM a WHERE p % 10 = 1), f AS (SELECT * FROM a WHERE p % 10 = 6)
SELECT s.rank, s.idx AS index, f.idx AS fwdbwd_index, 0 AS fwdbwd FROM s JOIN f ON s.rank = f.rank AND f.p = s.p + 5 UNION ALL SELECT s.rank, f.idx, s.idx, 1 FROM s JOIN f ON s.rank = f.rank AND f.p = s.p + 5""",
)
def backward_links(events):
    from pyspark.sql import Window

    placed = events.where("cat = 'cpu_op'").withColumn("p", F.row_number().over(Window.partitionBy("rank").orderBy("ts", "index")))
    flows = placed.where("p % 10 in (1, 6)").select("rank", F.floor(F.col("p") / 10).cast("string").alias("id"), F.when(F.col("p") % 10 == 1, "s").otherwise("f").alias("ph"), "ts", "tid", "pid")
    return silver.with_backward_links(events, flows).where("fwdbwd >= 0").select("rank", "index", "fwdbwd_index", "fwdbwd")


@query("overlay_patterns")
def overlay_patterns(events):
    rows, pairs = with_pairs(events)
    sequences = kept(callstack.sequences(rows, pairs, "aten"))
    found = callstack.frequent_sequences(rows, pairs, "aten", least=1, rows=sequences)
    return callstack.overlay_patterns(rows, pairs, found, "aten", rows=sequences).select("rank", "index", "pattern")


@plain_query(
    "ep_group_wide",
    f"""WITH {STEPS} SELECT CAST(rank % 2 AS INT) AS group_id, micro_batch, min(ts) FILTER (direction = 'forward') / 1000.0 AS forward_start_min, max(dur) FILTER (direction = 'backward') / 1000.0 AS backward_dur_max FROM steps GROUP BY ALL""",
)
def ep_group_wide(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("event", F.col("direction"))
    wide = parallel.expert_wide(parallel.expert_statistics(rows, parallel.rank_groups(spark, {"tp": 2, "ep": 2}, "ep")), ["forward", "backward"])
    return wide.select("group_id", "micro_batch", "forward_start_min", "backward_dur_max")


@plain_query("bubble_ratios", "SELECT CAST(k AS INT) AS p, (k - 1) / CAST(k - 1 + 8 AS DOUBLE) AS plain, (k - 1) / CAST(8 AS DOUBLE) / 2 AS interleaved, n FROM (SELECT on_ + 1 AS k, n FROM (" + ON(8) + "))")
def bubble_ratios(spark, sf_dir):
    p = F.col("stage") + 1
    return events_on(spark, sf_dir, 8, "stage").select(p.alias("p"), "n", N.bubble_ratio(p, F.lit(8)).alias("plain"), N.bubble_ratio(p, F.lit(8), F.lit(2)).alias("interleaved"))


@query("timeline_events", " SELECT rank, idx AS index, CASE WHEN name LIKE '%(%' THEN trim(regexp_replace(regexp_replace(name, '<.*>', ''), '\\(.*\\)', '')) ELSE name END AS label, dur AS duration FROM tr WHERE stream <> -1")
def timeline_events(events):
    return events.where(N.is_gpu_stream()).select("rank", "index", F.trim(N.simple_name(F.col("name"))).alias("label"), F.col("dur").alias("duration"))

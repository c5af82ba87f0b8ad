"""Critical-path queries over a trace with two overlapping threads, sibling calls, locks, synchronising calls and stream waits, derived from the driver's events; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import critical_path, silver
from ..operators.keep import kept
from .fixtures import DAY


def threaded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiler steps of a day; on each of two threads operators with two calls within, kernels on two streams, rows of waiting. TH is the same in SQL."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = raw.join(F.broadcast(raw.agg(F.min(us).alias("t0")))).select(
        F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("int").alias("rank"), (F.col("event_id") % 2).cast("int").alias("tid"), F.col("event_type").alias("et"),
        (us - F.col("t0")).alias("t"), F.round(F.col("value") * 10_000_000).cast("long").alias("d"),
    )
    e = e.withColumn("day", F.floor(F.col("t") / float(DAY)).cast("long"))
    e = e.withColumn("nxt", F.lead("t").over(Window.partitionBy("rank", "tid", "day").orderBy("t", "id")))
    e = e.withColumn("od", F.least("d", F.coalesce(F.col("nxt") - F.col("t"), F.col("d")), (F.col("day") + 1) * DAY - F.col("t")))
    recorded = Window.partitionBy("rank", "day").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("record", F.last(F.when(F.col("et") == "view", 2 * F.col("id") + 2), ignorenulls=True).over(recorded))
    e = e.withColumns({"h": F.expr("od div 8"), "lt": F.expr("t + od div 4"), "st": F.expr("t + od div 2"), "k": F.when(F.col("et") == "purchase", 20).otherwise(7)})
    et, none, i, c = F.col("et"), F.lit(-1), 5 * F.col("id"), 2 * F.col("id")

    def row(index, tid, stream, ts, dur, name, cat, corr, record=none):
        kinds = {"index": (index, "long"), "tid": (tid, "int"), "stream": (stream, "int"), "ts": (ts, "long"), "dur": (dur, "long"), "name": (name, "string"), "cat": (cat, "string"), "correlation": (corr, "long"), "wait_on_cuda_event_record_corr_id": (record, "long")}
        return F.struct(*[v.cast(t).alias(k) for k, (v, t) in kinds.items()])

    host = F.lit("cuda_runtime")
    second = F.when(et == "purchase", "cudaStreamSynchronize").when(et == "view", "cudaEventRecord").when(et == "error", "cudaStreamWaitEvent").otherwise("aten::empty")
    calls = et.isin("purchase", "view", "error")
    rows = F.array(
        row(i, F.col("tid"), none, F.col("t"), F.col("od"), F.when(et == "click", "aten::mm").otherwise("aten::add"), F.lit("cpu_op"), none),
        row(i + 1, F.col("tid"), none, F.col("lt"), F.col("h"), F.when(et == "view", "cudaMemcpyAsync").otherwise("cudaLaunchKernel"), host, c + 1),
        row(i + 2, F.col("tid"), none, F.col("st"), F.col("h"), second, F.when(calls, host).otherwise("cpu_op"), F.when(calls, c + 2).otherwise(-1), F.when(et == "error", F.coalesce("record", none)).otherwise(-1)),
        row(i + 3, F.col("k"), F.col("k"), F.expr("lt + h + (id * 7919 % 100) * 10000"), F.expr("if(id % 3 = 0, d, d div 50)"), F.when(et == "purchase", "ncclKernel_AllReduce").otherwise("gemm_kernel"), F.when(et == "view", "gpu_memcpy").otherwise("kernel"), c + 1),
        row(i + 4, F.col("k"), F.col("k"), F.col("st"), F.col("h"), F.lit("Stream Sync"), F.lit("cuda_sync"), c + 2),
    )
    rows = e.select("rank", F.explode(F.when(et == "purchase", rows).otherwise(F.slice(rows, 1, 4))).alias("r"))
    step = row(-1 - F.col("day"), F.lit(0), none, F.col("day") * DAY, F.lit(DAY), F.concat(F.lit("ProfilerStep#"), F.col("day").cast("string")), F.lit("user_annotation"), none)
    steps = e.select("rank", "day").distinct().select("rank", step.alias("r"))
    out = rows.unionByName(steps).select("rank", "r.*")
    return out.withColumns({"pid": F.col("rank"), "end": F.col("ts") + F.col("dur"), "wait_on_stream": F.when(F.col("wait_on_cuda_event_record_corr_id") >= 0, 7).otherwise(-1)})


TH = """te AS (SELECT event_id AS id, CAST(user_id % 4 AS INT) AS rank, CAST(event_id % 2 AS INT) AS tid, event_type AS et, epoch_us(ts) - min(epoch_us(ts)) OVER () AS t, CAST(round(value * 10000000) AS BIGINT) AS d FROM events),
td AS (SELECT *, t // 86400000000 AS day FROM te),
tn AS (SELECT *, lead(t) OVER (PARTITION BY rank, tid, day ORDER BY t, id) AS nxt,
  last_value(CASE WHEN et = 'view' THEN 2 * id + 2 END IGNORE NULLS) OVER (PARTITION BY rank, day ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS record FROM td),
tl AS (SELECT *, least(d, coalesce(nxt - t, d), (day + 1) * 86400000000 - t) AS od FROM tn),
th AS (
 SELECT rank, -1 - day AS idx, 0 AS tid, -1 AS stream, day * 86400000000 AS ts, 86400000000 AS dur, concat('ProfilerStep#', day) AS name, 'user_annotation' AS cat, -1 AS corr, -1 AS record FROM (SELECT DISTINCT rank, day FROM tl) x
 UNION ALL SELECT rank, 5 * id, tid, -1, t, od, CASE WHEN et = 'click' THEN 'aten::mm' ELSE 'aten::add' END, 'cpu_op', -1, -1 FROM tl
 UNION ALL SELECT rank, 5 * id + 1, tid, -1, t + od // 4, od // 8, CASE WHEN et = 'view' THEN 'cudaMemcpyAsync' ELSE 'cudaLaunchKernel' END, 'cuda_runtime', 2 * id + 1, -1 FROM tl
 UNION ALL SELECT rank, 5 * id + 2, tid, -1, t + od // 2, od // 8, CASE et WHEN 'purchase' THEN 'cudaStreamSynchronize' WHEN 'view' THEN 'cudaEventRecord' WHEN 'error' THEN 'cudaStreamWaitEvent' ELSE 'aten::empty' END,
   CASE WHEN et IN ('purchase', 'view', 'error') THEN 'cuda_runtime' ELSE 'cpu_op' END, CASE WHEN et IN ('purchase', 'view', 'error') THEN 2 * id + 2 ELSE -1 END, CASE WHEN et = 'error' THEN coalesce(record, -1) ELSE -1 END FROM tl
 UNION ALL SELECT rank, 5 * id + 3, CASE WHEN et = 'purchase' THEN 20 ELSE 7 END, CASE WHEN et = 'purchase' THEN 20 ELSE 7 END, t + od // 4 + od // 8 + (id * 7919 % 100) * 10000, CASE WHEN id % 3 = 0 THEN d ELSE d // 50 END,
   CASE WHEN et = 'purchase' THEN 'ncclKernel_AllReduce' ELSE 'gemm_kernel' END, CASE WHEN et = 'view' THEN 'gpu_memcpy' ELSE 'kernel' END, 2 * id + 1, -1 FROM tl
 UNION ALL SELECT rank, 5 * id + 4, 20, 20, t + od // 2, od // 8, 'Stream Sync', 'cuda_sync', 2 * id + 2, -1 FROM tl WHERE et = 'purchase')"""

# what a row's parent is, and which row launched a kernel, follows from how the fixture numbers its rows
EDGES = (
    "WITH RECURSIVE " + TH + """,
wn AS (SELECT rank, ts AS a, ts + dur AS z FROM th WHERE name = 'ProfilerStep#2'),
h AS (SELECT th.* FROM th JOIN wn USING (rank) WHERE stream = -1 AND ts BETWEEN a AND z AND dur > 0 AND cat <> 'user_annotation'),
dv AS (SELECT *, ts + dur AS fin, CASE WHEN cat = 'cuda_sync' THEN idx - 2 ELSE idx - 2 END AS launch FROM th WHERE stream <> -1 AND EXISTS (SELECT 1 FROM h WHERE h.rank = th.rank AND h.corr = th.corr)),
k AS (SELECT * FROM dv WHERE cat <> 'cuda_sync'),
pt AS (SELECT rank, tid, idx, name, ts AS moment, 2 AS class, -dur AS o1, idx AS o2, 1 AS delta, 2 * idx AS node FROM h UNION ALL SELECT rank, tid, idx, name, ts + dur, 1, dur, -idx, -1, 2 * idx + 1 FROM h),
wk AS (SELECT *, name IN ('cudaHostAlloc', 'cudaLaunchKernel', 'cudaMemcpyAsync') AS locks, coalesce(sum(delta) OVER (PARTITION BY rank, tid ORDER BY moment, class, o1, o2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  row_number() OVER (PARTITION BY rank, tid ORDER BY moment, class, o1, o2) AS p FROM pt),
cpu AS (SELECT y.rank, x.node AS a, y.node AS b, CASE WHEN y.delta = 1 AND y.held = 0 THEN 'dependency' ELSE 'operator_kernel' END AS kind,
   CASE WHEN y.delta = 1 AND y.held = 0 THEN NULL WHEN x.delta = 1 THEN x.idx WHEN y.delta = -1 THEN y.idx ELSE y.idx // 5 * 5 END AS idx,
   CASE WHEN (y.delta = 1 AND y.held = 0) OR (y.delta = -1 AND y.name = 'cudaStreamSynchronize') THEN 0 ELSE y.moment - x.moment END AS w
 FROM wk x JOIN wk y ON x.rank = y.rank AND x.tid = y.tid AND y.p = x.p + 1 WHERE NOT (x.locks AND y.locks AND (x.delta = 1 OR y.delta = -1))),
lp AS (SELECT rank, idx, dur, moment, starts, row_number() OVER (PARTITION BY rank ORDER BY moment, idx, starts DESC) AS p FROM (
   SELECT rank, idx, dur, ts AS moment, 1 AS starts FROM h WHERE name IN ('cudaLaunchKernel', 'cudaMemcpyAsync') UNION ALL SELECT rank, idx, dur, ts + dur, 0 FROM h WHERE name IN ('cudaLaunchKernel', 'cudaMemcpyAsync')) z),
lk AS (SELECT s.rank, 2 * s.idx AS a, 2 * e.idx + 1 AS b, CASE WHEN s.idx = e.idx THEN 'operator_kernel' ELSE 'dependency' END AS kind, CASE WHEN s.idx = e.idx THEN s.idx END AS idx, CASE WHEN s.idx = e.idx THEN s.dur ELSE 0 END AS w
  FROM lp s JOIN lp e ON e.rank = s.rank AND e.p = (SELECT min(f.p) FROM lp f WHERE f.rank = s.rank AND f.p > s.p AND f.starts = 0) WHERE s.starts = 1
  UNION ALL SELECT s.rank, 2 * s.idx + 1, 2 * e.idx + 1, 'dependency', NULL, 0 FROM lp s JOIN lp e ON e.rank = s.rank AND e.p = s.p + 1 WHERE s.starts = 0 AND e.starts = 0),
qp AS (SELECT k.rank, k.stream, k.idx AS kernel, h.ts, h.idx, 1 AS delta FROM k JOIN h ON h.rank = k.rank AND h.idx = k.launch UNION ALL SELECT k.rank, k.stream, k.idx, k.ts, k.idx, -1 FROM k JOIN h ON h.rank = k.rank AND h.idx = k.launch),
qs AS (SELECT rank, kernel, delta, sum(delta) OVER (PARTITION BY rank, stream ORDER BY ts, delta DESC, idx) AS q FROM qp),
wt AS (SELECT x.rank, x.idx, n.idx AS nxt, (SELECT arg_max(s.idx, s.ts) FROM k s WHERE s.rank = x.rank AND s.ts <= r.ts) AS src
  FROM h x JOIN h r ON r.rank = x.rank AND r.corr = x.record JOIN k n ON n.rank = x.rank AND n.stream = 7 AND n.ts = (SELECT min(m.ts) FROM k m WHERE m.rank = x.rank AND m.stream = 7 AND m.ts > x.ts) WHERE x.name = 'cudaStreamWaitEvent' AND x.record >= 0),
wd AS (SELECT DISTINCT rank, src, nxt FROM wt WHERE src IS NOT NULL AND src <> nxt),
we AS (SELECT g.rank, g.nxt AS idx, k.fin AS s_end FROM (SELECT rank, nxt, max(src) AS src FROM wd GROUP BY ALL) g JOIN k ON k.rank = g.rank AND k.idx = g.src),
kk AS (SELECT k.*, lag(k.idx) OVER s AS prv, lag(k.fin) OVER s AS prv_end, h.ts AS l_ts, we.s_end, coalesce(q1.q, 1) AS ql, coalesce(q2.q, 0) AS qk
  FROM k LEFT JOIN h ON h.rank = k.rank AND h.idx = k.launch LEFT JOIN we ON we.rank = k.rank AND we.idx = k.idx LEFT JOIN qs q1 ON q1.rank = k.rank AND q1.kernel = k.idx AND q1.delta = 1 LEFT JOIN qs q2 ON q2.rank = k.rank AND q2.kernel = k.idx AND q2.delta = -1
  WINDOW s AS (PARTITION BY k.rank, k.stream ORDER BY k.ts, k.idx)),
kf AS (SELECT *, l_ts IS NOT NULL AND ql = 1 AND qk = 0 AND coalesce(prv_end < l_ts, true) AND coalesce(s_end < l_ts, true) AS idle FROM kk),
every AS (SELECT * FROM cpu UNION ALL SELECT * FROM lk
  UNION ALL SELECT rank, 2 * idx, 2 * idx + 1, 'operator_kernel', idx, dur FROM k
  UNION ALL SELECT rank, 2 * launch, 2 * idx, 'launch_delay', NULL, ts - l_ts FROM kf WHERE idle
  UNION ALL SELECT rank, 2 * prv + 1, 2 * idx, 'kernel_kernel_delay', prv, ts - prv_end FROM kf WHERE NOT idle AND prv IS NOT NULL AND ts - prv_end < 1500 AND coalesce(s_end < prv_end, true)
  UNION ALL SELECT s.rank, 2 * (SELECT arg_max(k.idx, k.ts) FROM k WHERE k.rank = s.rank AND k.stream = s.stream AND k.ts <= s.fin) + 1, 2 * s.launch + 1, 'sync_dependency', NULL, 0
    FROM dv s JOIN h c ON c.rank = s.rank AND c.idx = s.launch WHERE s.cat = 'cuda_sync'
  UNION ALL SELECT rank, 2 * src + 1, 2 * nxt, 'sync_dependency', NULL, 0 FROM wd),
edges AS (SELECT rank, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, kind, CAST(idx AS BIGINT) AS idx, CAST(greatest(w, 0) AS BIGINT) AS weight FROM every WHERE a IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rank, a, b ORDER BY kind <> 'sync_dependency', kind <> 'dependency', kind) = 1)"""
)

LONGEST = EDGES + """,
nd AS (SELECT rank, 2 * idx AS node FROM h UNION ALL SELECT rank, 2 * idx + 1 FROM h UNION ALL SELECT rank, 2 * idx FROM k UNION ALL SELECT rank, 2 * idx + 1 FROM k),
far(rank, node, reached) USING KEY (rank, node) AS (
  SELECT rank, CAST(node AS BIGINT), CAST(0 AS BIGINT) FROM nd
  UNION SELECT e.rank, e.b, max(f.reached + e.weight) FROM far f JOIN edges e ON e.rank = f.rank AND e.a = f.node JOIN recurring.far o ON o.rank = e.rank AND o.node = e.b GROUP BY e.rank, e.b HAVING max(f.reached + e.weight) > max(o.reached)),
come AS (SELECT e.rank, e.b, min(e.a) AS a FROM edges e JOIN far x ON x.rank = e.rank AND x.node = e.a JOIN far y ON y.rank = e.rank AND y.node = e.b WHERE x.reached + e.weight = y.reached GROUP BY e.rank, e.b),
path AS (SELECT rank, min(node) AS node, CAST(0 AS BIGINT) AS back FROM far f WHERE reached = (SELECT max(reached) FROM far g WHERE g.rank = f.rank) GROUP BY rank
  UNION ALL SELECT p.rank, c.a, p.back + 1 FROM path p JOIN come c ON c.rank = p.rank AND c.b = p.node)"""  # fmt: skip


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(critical_path.clip(silver.with_index_correlation(threaded_events(spark, sf_dir)), "ProfilerStep", 2))


def critical_path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critical_path.edges(clipped(spark, sf_dir))


def critical_path_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clipped(spark, sf_dir)
    return critical_path.critical_path(rows, links=kept(critical_path.edges(rows))).select("rank", "node", "position", "reached")


def critical_path_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clipped(spark, sf_dir)
    links = kept(critical_path.edges(rows))
    return critical_path.summary(critical_path.breakdown(rows, critical_path.critical_path(rows, links=links), links=links))


QUERIES = {"critical_path_edges": critical_path_edges, "critical_path_longest": critical_path_longest, "critical_path_breakdown": critical_path_breakdown}
ORACLES = {
    "critical_path_edges": EDGES + " SELECT rank, a, b, kind, idx AS index, weight FROM edges",
    "critical_path_longest": LONGEST + " SELECT p.rank, p.node, max(back) OVER (PARTITION BY p.rank) - back AS position, f.reached FROM path p JOIN far f ON f.rank = p.rank AND f.node = p.node",
    "critical_path_breakdown": LONGEST + """,
steps AS (SELECT x.rank, x.node AS a, y.node AS b FROM path x JOIN path y ON x.rank = y.rank AND x.back = y.back + 1),
bound AS (SELECT e.rank, e.weight, CASE kind WHEN 'launch_delay' THEN 'gpu_kernel_launch_overhead' WHEN 'kernel_kernel_delay' THEN 'gpu_kernel_kernel_overhead' WHEN 'sync_dependency' THEN 'sync' WHEN 'dependency' THEN 'dependency'
  ELSE CASE WHEN th.stream = -1 THEN 'cpu_bound' WHEN th.name LIKE 'nccl%' THEN 'gpu_communication_bound' ELSE 'gpu_compute_bound' END END AS bound_by
  FROM steps s JOIN edges e ON e.rank = s.rank AND e.a = s.a AND e.b = s.b LEFT JOIN th ON th.rank = e.rank AND th.idx = e.idx)
SELECT rank, bound_by, CAST(sum(weight) AS BIGINT) AS time, CASE WHEN sum(sum(weight)) OVER (PARTITION BY rank) > 0 THEN round(sum(weight) * 100.0 / sum(sum(weight)) OVER (PARTITION BY rank), 2) END AS percentage FROM bound GROUP BY rank, bound_by""",
}

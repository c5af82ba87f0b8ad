"""Pipeline-parallel runs for the schedule queries, derived from the driver's events, as DataFrames and as SQL: every so many events are the rows of one group, whose durations come from the events' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES, MICRO_BATCHES, VIRTUAL = 4, 8, 2


#: Rows of a group: steps, and transfers without the optimizer's.
PER_GROUP, TRANSFERS_PER_GROUP = STAGES * 2 * MICRO_BATCHES * VIRTUAL, STAGES * MICRO_BATCHES * 6


def events_in_groups(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(group, k, v): the k-th event of each whole group of `size` events, and a hundred times its value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    groups = events.groupBy(F.floor(F.col("event_id") / size).cast("int").alias("group")).agg(F.count("*").alias("n")).where(F.col("n") == size).select("group")
    rows = events.select(F.floor(F.col("event_id") / size).cast("int").alias("group"), (F.col("event_id") % size).alias("k"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return rows.join(groups, "group")


def _grouped_sql(size: int) -> str:
    return f"""(SELECT CAST(event_id // {size} AS INT) AS "group", event_id % {size} AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE event_id // {size} < (SELECT count(*) // {size} FROM events)) t"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, rank, stage, direction, micro_batch, ts, dur): compute steps; stage counts virtual stages from 1."""
    k = F.col("k")
    base = events_in_groups(spark, sf_dir, PER_GROUP).select(
        "group", "v", (k % STAGES).cast("int").alias("rank"), (F.floor(k / STAGES) % 2).cast("int").alias("d"),
        (F.floor(k / (STAGES * 2)) % MICRO_BATCHES).cast("int").alias("micro_batch"), (F.floor(k / (STAGES * 2 * MICRO_BATCHES)) + 1).cast("int").alias("stage"),
    )
    forward = F.col("d") == 0
    place = F.when(forward, F.col("stage")).otherwise(VIRTUAL + 1 - F.col("stage"))
    ring = F.when(forward, F.col("rank")).otherwise(STAGES - 1 - F.col("rank"))
    return base.select(
        "group", "rank", "stage", "micro_batch", F.when(forward, "forward").otherwise("backward").alias("direction"),
        (1_000_000 * F.col("micro_batch") + 250_000 * (place - 1) + 60_000 * ring + F.when(forward, 0).otherwise(500_000)).cast("long").alias("ts"),
        (40_000 + F.col("v")).alias("dur"),
    )


STEPS = f"""st AS (SELECT "group", v, CAST(k % {STAGES} AS INT) AS rank, CAST(k // {STAGES} % 2 AS INT) AS d, CAST(k // {STAGES * 2} % {MICRO_BATCHES} AS INT) AS micro_batch, CAST(k // {STAGES * 2 * MICRO_BATCHES} + 1 AS INT) AS stage
  FROM {_grouped_sql(PER_GROUP)}),
steps AS (SELECT "group", rank, stage, micro_batch, CASE d WHEN 0 THEN 'forward' ELSE 'backward' END AS direction,
 CAST(1000000 * micro_batch + 250000 * (CASE d WHEN 0 THEN stage ELSE {VIRTUAL + 1} - stage END - 1) + 60000 * (CASE d WHEN 0 THEN rank ELSE {STAGES - 1} - rank END) + 500000 * d AS BIGINT) AS ts,
 40000 + v AS dur FROM st)"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1F1B rows of groups of four stages: each micro-batch's receive, compute and send, forward then backward, and the optimizer."""
    names = F.array(*map(F.lit, ["recv_forward", "forward_step", "send_forward", "recv_backward", "backward_step", "send_backward"]))
    k = F.col("k")
    rows = events_in_groups(spark, sf_dir, TRANSFERS_PER_GROUP).select("group", "v", (k % STAGES).cast("int").alias("rank"), (F.floor(k / STAGES) % 6).cast("int").alias("n"), F.floor(k / (STAGES * 6)).cast("int").alias("mb"))
    rows = rows.select(
        "group", "rank", F.col("rank").alias("stage"), F.get(names, F.col("n")).alias("name"), (F.col("mb") * 6 + F.col("n")).cast("long").alias("index"),
        (1_000_000 * F.col("mb") + 150_000 * F.col("n") + 10_000 * F.col("rank")).cast("long").alias("ts"),
        (20_000 + F.col("v")).alias("dur"),
    )
    end = rows.select("group", "rank").distinct().select(
        "group", "rank", F.col("rank").alias("stage"), F.lit("optimizer_step").alias("name"), F.lit(1000).cast("long").alias("index"),
        F.lit(1_000_000 * MICRO_BATCHES).cast("long").alias("ts"), F.lit(5000).cast("long").alias("dur"),
    )
    inner = ~(((F.col("stage") == 0) & F.col("name").isin("send_backward")) | ((F.col("stage") == STAGES - 1) & F.col("name").isin("send_forward", "recv_backward")))
    return rows.unionByName(end).where(inner).withColumn("kernel_span", F.col("dur"))


TRANSFERS = f"""tk AS (SELECT "group", v, CAST(k % {STAGES} AS INT) AS rank, CAST(k // {STAGES} % 6 AS INT) AS n, CAST(k // {STAGES * 6} AS INT) AS mb FROM {_grouped_sql(TRANSFERS_PER_GROUP)}),
tall AS (SELECT "group", rank, rank AS stage, ['recv_forward', 'forward_step', 'send_forward', 'recv_backward', 'backward_step', 'send_backward'][n + 1] AS name, CAST(mb * 6 + n AS BIGINT) AS index,
 CAST(1000000 * mb + 150000 * n + 10000 * rank AS BIGINT) AS ts, 20000 + v AS dur FROM tk
 UNION ALL SELECT DISTINCT "group", rank, rank, 'optimizer_step', 1000, {1_000_000 * MICRO_BATCHES}, 5000 FROM tk),
rows_ AS (SELECT *, dur AS kernel_span FROM tall WHERE NOT ((stage = 0 AND name = 'send_backward') OR (stage = {STAGES - 1} AND name IN ('send_forward', 'recv_backward')))),
fo AS (SELECT *, row_number() OVER (PARTITION BY "group", rank, name ORDER BY ts, index) - 1 AS k FROM rows_),
pf AS (SELECT s."group" AS g, s.rank AS r1, s.index AS i1, r.rank AS r2, r.index AS i2, least(s.kernel_span, r.kernel_span) AS comm FROM fo s JOIN fo r ON r."group" = s."group" AND r.stage = s.stage + 1 AND r.k = s.k WHERE s.name = 'send_forward' AND r.name = 'recv_forward'),
pb AS (SELECT s."group" AS g, s.rank AS r1, s.index AS i1, r.rank AS r2, r.index AS i2, least(s.kernel_span, r.kernel_span) AS comm FROM fo s JOIN fo r ON r."group" = s."group" AND r.stage = s.stage - 1 AND r.k = s.k WHERE s.name = 'send_backward' AND r.name = 'recv_backward'),
cm AS (SELECT g, r1 AS rr, i1 AS ii, comm FROM pf UNION ALL SELECT g, r2, i2, comm FROM pf UNION ALL SELECT g, r1, i1, comm FROM pb UNION ALL SELECT g, r2, i2, comm FROM pb),
linked AS (SELECT r.*, coalesce(comm, 0) AS comm_time, kernel_span - coalesce(comm, 0) AS wait FROM rows_ r LEFT JOIN cm ON "group" = g AND rank = rr AND index = ii)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated rows of an interleaved schedule: each step of steps() and the receive before it, some receives without kernels."""
    rows = steps(spark, sf_dir).withColumnRenamed("stage", "chunk")
    k = F.col("rank") + F.col("micro_batch") + F.col("chunk") + F.col("group")
    step = lambda name, ts, dur, kernels, first, span: F.struct(name.alias("name"), ts.alias("ts"), dur.alias("dur"), kernels.alias("num_kernels"), first.alias("first_kernel_start"), span.alias("kernel_span"))
    both = F.array(
        step(F.concat(F.lit("recv_"), "direction"), F.col("ts") - 9000, (4000 + 100 * (k % 11)).cast("long"), F.when(k % 5 == 0, 0).otherwise(1), F.col("ts") - 8000, (1000 + 50 * (k % 7)).cast("long")),
        step(F.concat("direction", F.lit("_step")), F.col("ts"), F.col("dur"), F.lit(3), F.col("ts") + 500 * (F.col("group") % 3), F.col("dur") - 700),
    )
    return rows.select("group", "rank", F.col("rank").alias("stage"), "chunk", "micro_batch", F.explode(both).alias("r")).select("*", "r.*").drop("r")


ANNOTATED = f"""{STEPS}, sg AS (SELECT "group" AS g, rank, stage AS chunk, micro_batch, direction, ts, dur, rank + micro_batch + stage + "group" AS k FROM steps),
annotated AS (SELECT g AS "group", rank, rank AS stage, 'recv_' || direction AS name, ts - 9000 AS ts, 4000 + 100 * (k % 11) AS dur, CASE k % 5 WHEN 0 THEN 0 ELSE 1 END AS num_kernels, ts - 8000 AS fks, 1000 + 50 * (k % 7) AS span FROM sg
 UNION ALL SELECT g, rank, rank, direction || '_step', ts, dur, 3, ts + 500 * (g % 3), dur - 700 FROM sg)"""

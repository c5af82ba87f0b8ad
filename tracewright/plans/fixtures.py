"""A well-nested trace projected from the driver's events table, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiler steps, operators, launches and kernels; see TR for the same in SQL."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = raw.agg(F.min(us).alias("t0"))
    e = raw.join(F.broadcast(start)).select(
        F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("int").alias("rank"), F.col("event_type").alias("et"), (us - F.col("t0")).alias("t"),
        F.round(F.col("value") * 10_000_000).cast("long").alias("d"),
    )
    b = e.withColumn("day", F.floor(F.col("t") / float(DAY)).cast("long"))
    # operators are cut at the end of their day, so the next one matters within the day only
    b = b.withColumn("nxt", F.lead("t").over(Window.partitionBy("rank", "day").orderBy("t", "id")))
    c = b.withColumn("od", F.least("d", F.coalesce(F.col("nxt") - F.col("t"), F.col("d")), (F.col("day") + 1) * DAY - F.col("t")))
    row = c.withColumns({"lt": F.col("t") + F.floor(F.col("od") / 4.0).cast("long"), "ld": F.floor(F.col("od") / 8.0).cast("long")})
    et = F.col("et")
    pick = lambda other, **names: F.coalesce(*[F.when(et == k, v) for k, v in names.items()], F.lit(other))
    stream = F.when(et == "purchase", 20).otherwise(7)
    event = lambda index, tid, on, ts, dur, name, cat, corr, bw: F.struct(
        index.cast("long").alias("index"), tid.alias("tid"), on.alias("stream"), ts.alias("ts"), dur.alias("dur"), name.alias("name"), cat.alias("cat"), corr.cast("long").alias("correlation"), bw.alias("memory_bw_gbps")
    )
    zero, none, still = F.lit(0), F.lit(-1), F.lit(0.0)
    bandwidth = F.when(et.isin("view", "error"), (F.col("id") % 100) / 10.0).otherwise(0.0)
    three = F.array(
        event(3 * F.col("id"), zero, none, F.col("t"), F.col("od"), pick("aten::zero_", click="aten::mm", signup="aten::add", purchase="nccl:all_reduce", view="aten::copy_"), F.lit("cpu_op"), none, still),
        event(3 * F.col("id") + 1, zero, none, F.col("lt"), F.col("ld"), pick("cudaLaunchKernel", view="cudaMemcpyAsync", error="cudaMemsetAsync"), F.lit("cuda_runtime"), F.col("id") + 1, still),
        event(
            3 * F.col("id") + 2, stream, stream, F.col("lt") + F.col("ld") + (F.col("id") * 7919 % 100000) * 1000, F.col("d"),
            pick("Memset (Device)", click="void gemm_kernel<float>(int)", signup="elementwise_kernel", purchase="ncclKernel_AllReduce", view="Memcpy HtoD (Pageable -> Device)"),
            pick("kernel", view="gpu_memcpy", error="gpu_memset"), F.col("id") + 1, bandwidth,
        ),
    )
    steps = row.select("rank", "day").distinct().select(
        "rank", event(-1 - F.col("day"), zero, none, F.col("day") * DAY, F.lit(DAY), F.concat(F.lit("ProfilerStep#"), F.col("day").cast("string")), F.lit("user_annotation"), none, still).alias("e")
    )
    rows = row.select("rank", F.explode(three).alias("e")).unionByName(steps).select("rank", "e.*")
    return rows.withColumns({"pid": F.col("rank"), "end": F.col("ts") + F.col("dur")})


#: The same as common table expressions for the SQL equivalents.
TR = """e AS (SELECT event_id AS id, CAST(user_id % 4 AS INT) AS rank, event_type AS et,
 epoch_us(ts) - min(epoch_us(ts)) OVER () AS t, CAST(round(value * 10000000) AS BIGINT) AS d FROM events),
b AS (SELECT *, CAST(floor(t / 86400000000.0) AS BIGINT) AS day, lead(t) OVER (PARTITION BY rank ORDER BY t, id) AS nxt FROM e),
c AS (SELECT *, least(d, coalesce(nxt - t, d), (day + 1) * 86400000000 - t) AS od FROM b),
l AS (SELECT *, t + CAST(floor(od / 4.0) AS BIGINT) AS lt, CAST(floor(od / 8.0) AS BIGINT) AS ld FROM c),
tr AS (SELECT *, ts + dur AS "end" FROM (
 SELECT rank, CAST(-1 - day AS BIGINT) AS idx, 0 AS tid, -1 AS stream, day * 86400000000 AS ts, CAST(86400000000 AS BIGINT) AS dur,
   concat('ProfilerStep#', CAST(day AS VARCHAR)) AS name, 'user_annotation' AS cat, CAST(-1 AS BIGINT) AS corr, 0.0 AS bw FROM (SELECT DISTINCT rank, day FROM l) x
 UNION ALL SELECT rank, 3*id, 0, -1, t, od, CASE et WHEN 'click' THEN 'aten::mm' WHEN 'signup' THEN 'aten::add' WHEN 'purchase' THEN 'nccl:all_reduce' WHEN 'view' THEN 'aten::copy_' ELSE 'aten::zero_' END, 'cpu_op', -1, 0.0 FROM l
 UNION ALL SELECT rank, 3*id+1, 0, -1, lt, ld, CASE WHEN et = 'view' THEN 'cudaMemcpyAsync' WHEN et = 'error' THEN 'cudaMemsetAsync' ELSE 'cudaLaunchKernel' END, 'cuda_runtime', id + 1, 0.0 FROM l
 UNION ALL SELECT rank, 3*id+2, CASE WHEN et = 'purchase' THEN 20 ELSE 7 END, CASE WHEN et = 'purchase' THEN 20 ELSE 7 END, lt + ld + (id * 7919 % 100000) * 1000, d,
   CASE et WHEN 'click' THEN 'void gemm_kernel<float>(int)' WHEN 'signup' THEN 'elementwise_kernel' WHEN 'purchase' THEN 'ncclKernel_AllReduce' WHEN 'view' THEN 'Memcpy HtoD (Pageable -> Device)' ELSE 'Memset (Device)' END,
   CASE WHEN et = 'view' THEN 'gpu_memcpy' WHEN et = 'error' THEN 'gpu_memset' ELSE 'kernel' END, id + 1, CASE WHEN et IN ('view', 'error') THEN (id % 100) / 10.0 ELSE 0.0 END FROM l) y)"""

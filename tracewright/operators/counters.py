"""Step functions over time: idle gaps, launch queues, memory bandwidth, memory use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .kernels import describe
from .scans import SEGMENT_US, running


def idle_gaps(events: DataFrame, kernel_delay: int = 30) -> DataFrame:
    """Device rows (synchronisation left out) with the gap before them on their stream and its category.

    host_wait if the launch came after the previous kernel's end, kernel_wait
    if not and the gap is below kernel_delay, else other. The first row of a stream has a null gap.
    """
    kernels = events.where(N.is_gpu_stream() & N.starts_like("cat", N.CATEGORY["kernel"]))
    launches = events.where("stream = -1 and correlation >= 0").select(F.col("rank").alias("l_rank"), F.col("correlation").alias("l_corr"), F.col("ts").alias("l_ts"))
    rows = kernels.join(launches, (F.col("rank") == F.col("l_rank")) & (F.col("correlation") == F.col("l_corr")), "left")
    before = F.lag(F.col("ts") + F.col("dur")).over(Window.partitionBy("rank", "stream").orderBy("ts", "index"))
    rows = rows.select("rank", "stream", "index", "ts", "l_ts", before.alias("before")).withColumn("gap", F.col("ts") - F.col("before"))
    category = F.when(F.col("l_ts") > F.col("before"), "host_wait").when(F.col("gap") < kernel_delay, "kernel_wait").otherwise("other")
    return rows.withColumn("idle_category", category)


def idle_breakdown(gaps: DataFrame) -> DataFrame:
    """(rank, stream, idle_category, idle_time, idle_time_ratio): sums of gaps and their share within the stream."""
    sums = gaps.groupBy("rank", "stream", "idle_category").agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("idle_time"))
    total = F.sum("idle_time").over(Window.partitionBy("rank", "stream"))
    return sums.withColumn("idle_time_ratio", F.when(total != 0, F.bround(F.col("idle_time") / total, 2)))


def idle_statistics(gaps: DataFrame) -> DataFrame:
    return describe(gaps.where("gap is not null"), ["rank", "stream", "idle_category"], "gap")


def _queue_points(events: DataFrame) -> DataFrame:
    kernels = events.where(N.is_gpu_stream() & (F.col("correlation") >= 0)).select("rank", "stream", "correlation", F.col("ts").alias("k_ts"), F.col("index").alias("k_index"))
    launches = events.where(F.col("name").isin(N.LAUNCHES) & (F.col("correlation") >= 0)).select("rank", "correlation", F.col("ts").alias("l_ts"), F.col("index").alias("l_index"))
    pairs = launches.join(kernels, ["rank", "correlation"])
    return pairs.select("rank", "stream", "k_index", F.expr("stack(2, l_ts, l_index, 1, k_ts, k_index, -1) as (ts, index, delta)"))


def _queue_lengths(points: DataFrame, segment: int) -> DataFrame:
    return running(points, ["rank", "stream"], ["ts", F.desc("delta"), "index"], F.floor(F.col("ts") / segment), sums={"queue_length": F.col("delta")})


def queue_series(events: DataFrame, segment: int = SEGMENT_US) -> DataFrame:
    """(rank, stream, ts, index, queue_length): launches add one, starts of their kernels take one away; holds until the next row."""
    return _queue_lengths(_queue_points(events), segment).select("rank", "stream", "ts", "index", "queue_length", "delta")


def queues_of_kernels(events: DataFrame, segment: int = SEGMENT_US) -> DataFrame:
    """(rank, index, q_launch, q_kernel): the queue's length after each kernel's launch and after its start."""
    lengths = _queue_lengths(_queue_points(events), segment)
    at = lambda delta: F.max(F.when(F.col("delta") == delta, F.col("queue_length")))
    return lengths.groupBy("rank", F.col("k_index").alias("index")).agg(at(1).alias("q_launch"), at(-1).alias("q_kernel"))


def queue_summary(series: DataFrame) -> DataFrame:
    return describe(series, ["rank", "stream"], "queue_length")


def time_blocked(events: DataFrame, series: DataFrame, most: int = 1024) -> DataFrame:
    """(rank, stream, duration, relative) of the time a launch queue is full; only streams that get there. Relative to the span of all starts on the rank."""
    order = Window.partitionBy("rank", "stream").orderBy("ts", F.desc("delta"), "index")
    held = series.withColumn("len_", F.lead("ts").over(order) - F.col("ts")).where(F.col("queue_length") >= most)
    span = events.groupBy(F.col("rank").alias("r_")).agg((F.max("ts") - F.min("ts")).alias("span_"))
    summed = held.groupBy("rank", "stream").agg(F.coalesce(F.sum("len_"), F.lit(0)).alias("duration_at_max_queue_length"))
    relative = F.when(F.col("span_") > 0, F.col("duration_at_max_queue_length") / F.col("span_"))
    return summed.join(span, F.col("rank") == F.col("r_")).select("rank", "stream", "duration_at_max_queue_length", relative.alias("relative_duration_at_max_queue_length"))


def bandwidth_series(events: DataFrame, segment: int = SEGMENT_US) -> DataFrame:
    """(rank, name, ts, memory_bw_gbps): total bandwidth of running copies by kind; a row at each time that changes it. Copies without duration last 1."""
    rows = events.where(N.is_gpu_stream() & N.starts_like("name", N.MEMORY)).withColumn("name", N.memory_kernel_type(F.col("name")))
    end = F.col("ts") + F.greatest(F.col("dur"), F.lit(1))
    rows = rows.select("rank", "name", "ts", end.alias("end"), F.col("memory_bw_gbps").alias("bw"))
    points = rows.select("rank", "name", F.expr("stack(2, ts, bw, end, -bw) as (ts, delta)")).groupBy("rank", "name", "ts").agg(F.sum("delta").alias("delta"))
    summed = running(points, ["rank", "name"], ["ts"], F.floor(F.col("ts") / segment), sums={"bw": F.col("delta")})
    return summed.select("rank", "name", "ts", F.round("bw", 6).alias("memory_bw_gbps"))


def bandwidth_summary(series: DataFrame) -> DataFrame:
    return describe(series.where("memory_bw_gbps > 0"), ["rank", "name"], "memory_bw_gbps")


def memory_timeline(allocations: DataFrame, categories: int = 8, keys: list[str] = (), segment: int = SEGMENT_US) -> DataFrame:
    """(keys, t, sizes) from rows (keys, seq, t, action, numbytes, category): running totals of each category, one row for each run of equal times.

    keys name a trace (its rank); without any, all rows are one trace's. Times below zero stand for what was there before; they count at the earliest
    time above zero. Actions create and destroy change totals; others keep them.
    """
    by = [f"key_{k}_" for k in keys] or ["all_"]
    named = allocations.withColumns({f"key_{k}_": F.col(k) for k in keys} or {"all_": F.lit(0)})
    firsts = named.where("t > 0").groupBy(*by).agg(F.min("t").alias("first_"))
    joined = named.join(F.broadcast(firsts), by, "left")  # one row for each trace
    moved = joined.withColumn("t", F.when(F.col("t") < 0, F.col("first_")).otherwise(F.col("t")))
    sign = F.when(F.col("action").isin("destroy", "free", "2"), -1).when(F.col("action").isin("create", "alloc", "preexisting", "0", "1"), 1).otherwise(0)
    summed = moved.groupBy(*by, "t").agg(*[F.sum(F.when(F.col("category") == k, sign * F.col("numbytes")).otherwise(0)).alias(f"c{k}") for k in range(categories)])
    totals = running(summed, by, ["t"], F.floor(F.col("t") / segment), sums={f"s{k}": F.col(f"c{k}") for k in range(categories)})
    return totals.select(*[F.col(f"key_{k}_").alias(k) for k in keys], "t", F.array(*[f"s{k}" for k in range(categories)]).alias("sizes"))


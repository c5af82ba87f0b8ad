"""Columns derived once for all analyses: correlation, iteration, alignment, trimming, forward/backward links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def with_index_correlation(events: DataFrame) -> DataFrame:
    """events with index_correlation: the index of the host or device row with the same correlation.

    -1 for rows without correlation, 0 for those whose partner is missing. Device rows are
    those on a stream, and synchronisation rows that stand on none.
    """
    device = F.col("stream") != -1
    sync = F.col("name").startswith("Event Sync") | F.col("name").startswith("Context Sync")
    keyed = events.where("correlation >= 0").select("rank", "correlation", "index", (device | sync).alias("d_"))
    side = lambda flag, name: keyed.where(F.col("d_") == flag).groupBy("rank", "correlation").agg(F.max("index").alias(name))
    pairs = side(True, "device_").join(side(False, "host_"), ["rank", "correlation"]).select(
        F.col("rank").alias("r_"), F.col("correlation").alias("c_"), "device_", "host_"
    )
    joined = events.join(pairs, (F.col("rank") == F.col("r_")) & (F.col("correlation") == F.col("c_")), "left")
    partner = F.when(device | sync, F.col("host_")).otherwise(F.col("device_"))
    return joined.withColumn("index_correlation", F.coalesce(partner, F.least(F.col("correlation"), F.lit(0)))).select(*events.columns, "index_correlation")


def with_iteration(events: DataFrame, only_positive_streams: bool = True) -> DataFrame:
    """events with iteration: the profiler step that host rows start in (of several the last by start), and its number on device rows through their launch.

    -1 where there is none. Steps of a rank number few, so they are broadcast to
    the range join. Device rows on stream 0 get one only without only_positive_streams.
    """
    steps = events.where((F.col("stream") == -1) & F.col("name").startswith("ProfilerStep")).select(
        F.col("rank").alias("s_rank"), F.col("ts").alias("s_ts"), (F.col("ts") + F.col("dur")).alias("s_end"), N.iteration_of(F.col("name")).alias("s_number")
    )
    per_rank = steps.groupBy("s_rank").agg(F.sort_array(F.collect_list(F.struct("s_ts", "s_end", "s_number"))).alias("steps_"))
    host = events.join(per_rank, F.col("rank") == F.col("s_rank"), "left")
    inside = F.filter("steps_", lambda s: (s["s_ts"] <= F.col("ts")) & (F.col("ts") < s["s_end"]))
    host = host.withColumn("own_", F.when(F.col("stream") == -1, F.element_at(inside, F.when(F.size(inside) > 0, -1)).getField("s_number"))).drop("s_rank", "steps_")
    launch = host.where("stream = -1").select(F.col("rank").alias("l_rank"), F.col("index").alias("l_index"), F.col("own_").alias("l_own"))
    gpu = N.is_gpu_positive() if only_positive_streams else N.is_gpu_stream()
    joined = host.join(launch, gpu & (F.col("rank") == F.col("l_rank")) & (F.col("index_correlation") == F.col("l_index")), "left")
    return joined.withColumn("iteration", F.coalesce("own_", "l_own", F.lit(-1)).cast("int")).select(*events.columns, "iteration")


def align_ranks(events: DataFrame) -> DataFrame:
    """events with all times relative to the earliest one of all ranks."""
    least = events.agg(F.min("ts").alias("least_"))
    moved = {"ts": F.col("ts") - F.col("least_")} | ({"end": F.col("end") - F.col("least_")} if "end" in events.columns else {})
    return events.join(F.broadcast(least)).withColumns(moved).drop("least_")


def trim_to_steps(events: DataFrame, include_last: bool = False) -> DataFrame:
    """Host rows that start before the last profiler step ends (with include_last) or starts, and the device rows that these launch.

    Ranks without a step stay whole. A device row stays at most once.
    """
    bound = F.max(F.col("ts") + F.col("dur")) if include_last else F.max("ts")
    steps = events.where((F.col("stream") == -1) & F.col("name").startswith("ProfilerStep"))
    bounds = steps.groupBy(F.col("rank").alias("b_rank")).agg(bound.alias("bound_"), F.count("*").alias("n_"))
    placed = events.join(F.broadcast(bounds), F.col("rank") == F.col("b_rank"), "left")
    keep = F.col("bound_").isNull() | (F.col("ts") < F.col("bound_"))
    if not include_last:
        keep = keep | (F.col("n_") == 1)
    host = placed.where((F.col("stream") == -1) & keep).select(*events.columns)
    launches = host.where("correlation >= 0").select(F.col("rank").alias("l_rank"), F.col("correlation").alias("l_corr"))
    device = events.where("stream <> -1").join(launches, (F.col("rank") == F.col("l_rank")) & (F.col("correlation") == F.col("l_corr")), "left_semi")
    return host.unionByName(device)


def with_backward_links(events: DataFrame, flows: DataFrame) -> DataFrame:
    """events with fwdbwd_index (index of the linked operator) and fwdbwd (0 forward, 1 backward), -1 where there is none.

    flows has rank, id, ph (s or f), ts, tid, pid. A flow end belongs to the host
    operator with the largest index that starts there.
    """
    ops = events.where("cat = 'cpu_op'").select("rank", "ts", "tid", "pid", "index")
    ends = flows.join(ops, ["rank", "ts", "tid", "pid"]).groupBy("rank", "id", "ph").agg(F.max("index").alias("index"))
    start, finish = (ends.where(F.col("ph") == ph).select("rank", "id", F.col("index").alias(ph)) for ph in ("s", "f"))
    pairs = start.join(finish, ["rank", "id"])
    links = pairs.select("rank", F.expr("stack(2, s, f, 0, f, s, 1) as (index, fwdbwd_index, fwdbwd)"))
    links = links.groupBy("rank", "index").agg(F.max_by(F.struct("fwdbwd_index", "fwdbwd"), "fwdbwd_index").alias("l_"))
    out = events.join(links, ["rank", "index"], "left")
    return out.select(*events.columns, F.coalesce("l_.fwdbwd_index", F.lit(-1)).alias("fwdbwd_index"), F.coalesce("l_.fwdbwd", F.lit(-1)).alias("fwdbwd"))


def symbols(events: DataFrame) -> DataFrame:
    """(sym_id, symbol): dense numbers of all distinct names and categories; few rows, ordered in one task."""
    found = events.select("name").union(events.select("cat")).where("name is not null").distinct()
    return found.select((F.row_number().over(Window.orderBy("name")) - 1).alias("sym_id"), F.col("name").alias("symbol"))

"""Kernel time: breakdowns by type and name, time use, overlap, launches, operators and their kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .intervals import buckets, containment_join, covered_time, overlap_states
from .quantiles import with_quartiles
from .scans import SEGMENT_US

#: Kinds of kernels with their bits, in the order of labels.
TYPE_BITS = {"COMPUTATION": 1, "COMMUNICATION": 2, "MEMORY": 4}


def gpu_rows(events: DataFrame) -> DataFrame:
    return events.where(N.is_gpu_stream()).withColumn("kernel_type", N.kernel_type("name"))


def time_statistics(df: DataFrame, keys: list[str], value: str = "dur") -> DataFrame:
    """sum, max, min, mean and sample standard deviation (0 for a single row) by keys."""
    return df.groupBy(*keys).agg(
        F.sum(value).alias("sum"), F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev")
    )


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear) and max by keys; exact, and no group is held in memory."""
    found = with_quartiles(df, keys, value, F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return found.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def type_breakdown(events: DataFrame, with_memory: bool = True, segment: int = SEGMENT_US) -> DataFrame:
    """(kernel_type, sum, percentage): time in which kinds run, alone or overlapping, over all ranks; largest first."""
    kinds = {k: b for k, b in TYPE_BITS.items() if with_memory or k != "MEMORY"}
    bit = F.expr("case kernel_type " + " ".join(f"when '{k}' then {b}" for k, b in kinds.items()) + " end")
    states = overlap_states(gpu_rows(events), ["rank"], bit, segment)
    label = F.array_join(F.array_compact(F.array(*[F.when(F.col("state").bitwiseAND(b) != 0, k) for k, b in kinds.items()])), " overlapping ")
    summed = states.groupBy("state").agg(F.sum(F.col("end") - F.col("ts")).alias("sum")).select(label.alias("kernel_type"), "sum")
    total = F.sum("sum").over(Window.partitionBy())
    return summed.withColumn("percentage", F.bround(F.col("sum") * 100.0 / total, 1)).orderBy(F.desc("sum"))


def top_with_others(stats: DataFrame, keys: list[str], limit: int, ratio: float = 0.8, always: list[str] = ()) -> DataFrame:
    """Statistics by name with the tail collapsed to `others` in groups of more than `limit` names.

    A name goes to others if the running sum, largest first, is above the
    linear quantile `ratio` of the running sums, or if `limit` names stand
    before it; names in `always` stay. In collapsed groups the statistics are
    those of the sums by name.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("sum"), "name")
    ranked = stats.withColumns(
        {"run_": F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, 0)), "at_": F.row_number().over(order), "n_": F.count("*").over(Window.partitionBy(*keys))}
    )
    cut = F.percentile("run_", F.lit(ratio)).over(Window.partitionBy(*keys))
    other = ~F.col("name").isin(list(always)) & ((F.col("run_") > F.col("cut_")) | (F.col("at_") > limit)) if always else (F.col("run_") > F.col("cut_")) | (F.col("at_") > limit)
    marked = ranked.withColumn("cut_", cut)
    small = marked.where(F.col("n_") <= limit).select(*keys, "name", "sum", "max", "min", "mean", "stddev")
    large = marked.where(F.col("n_") > limit).withColumn("name", F.when(other, "others").otherwise(F.col("name")))
    return small.unionByName(time_statistics(large, [*keys, "name"], "sum"))


def kernel_breakdown(events: DataFrame, limit: int = 10, ratio: float = 0.8, with_memory: bool = True) -> DataFrame:
    """Statistics by rank, kernel type and name, tails collapsed."""
    rows = gpu_rows(events).where(F.col("kernel_type").isin([k for k in TYPE_BITS if with_memory or k != "MEMORY"]))
    stats = time_statistics(rows, ["rank", "kernel_type", "name"])
    return top_with_others(stats, ["rank", "kernel_type"], limit, ratio)


def annotation_breakdown(events: DataFrame, gpu: bool = True, limit: int = 1000, ratio: float = 0.8, always: list[str] = ()) -> DataFrame:
    """Statistics of user annotations by rank and name; no rows without such a category."""
    rows = events.where(F.col("cat") == ("gpu_user_annotation" if gpu else "user_annotation"))
    return top_with_others(time_statistics(rows, ["rank", "name"]), ["rank"], limit, ratio, always)


def temporal_breakdown(events: DataFrame, segment: int = SEGMENT_US) -> DataFrame:
    """Idle, compute and other busy time of each rank, with percentages of the span of its device rows (null for a span of zero)."""
    rows = gpu_rows(events)
    span = covered_time(rows, ["rank"], segment)
    compute = covered_time(rows.where("kernel_type = 'COMPUTATION'"), ["rank"], segment).select(F.col("rank").alias("r_"), F.col("covered").alias("compute_"))
    joined = span.join(compute, F.col("rank") == F.col("r_"), "left").select(
        "rank", (F.col("last") - F.col("first")).alias("kernel_time"), (F.col("last") - F.col("first") - F.col("covered")).alias("idle_time"), F.coalesce("compute_", F.lit(0)).alias("compute_time")
    )
    joined = joined.withColumn("non_compute_time", F.col("kernel_time") - F.col("compute_time") - F.col("idle_time"))
    part = lambda c: F.when(F.col("kernel_time") > 0, F.bround(F.col(c) * 100.0 / F.col("kernel_time"), 2)).alias(f"{c}_pctg")
    return joined.select("rank", "idle_time", "compute_time", "non_compute_time", "kernel_time", part("idle_time"), part("compute_time"), part("non_compute_time"))


def communication_overlap(events: DataFrame, segment: int = SEGMENT_US) -> DataFrame:
    """(rank, comp_comm_overlap_pctg): share of communication during which computation runs; null without communication time."""
    bit = F.expr("case kernel_type when 'COMPUTATION' then 1 when 'COMMUNICATION' then 2 end")
    states = overlap_states(gpu_rows(events), ["rank"], bit, segment).withColumn("len_", F.col("end") - F.col("ts"))
    both, comm = F.sum(F.when(F.col("state") == 3, F.col("len_")).otherwise(0)), F.sum(F.when(F.col("state") >= 2, F.col("len_")).otherwise(0))
    return states.groupBy("rank").agg(F.when(comm > 0, F.bround(both * 100.0 / comm, 2)).alias("comp_comm_overlap_pctg"))


def launch_statistics(events: DataFrame, with_memory: bool = False) -> DataFrame:
    """(rank, correlation, cpu_duration, gpu_duration, launch_delay) of launches with a device row; the delay is at least 0."""
    names = ["cudaLaunchKernel", "cudaLaunchKernelExC", "runFunction - job_prep_and_submit_for_execution"]
    names += ["cudaMemcpyAsync", "cudaMemsetAsync"] if with_memory else []
    host = events.where(F.col("name").isin(names) & (F.col("correlation") >= 0)).select("rank", "correlation", F.col("ts").alias("h_ts"), F.col("dur").alias("cpu_duration"))
    device = events.where(N.is_gpu_stream() & (F.col("correlation") >= 0)).select("rank", "correlation", F.col("ts").alias("d_ts"), F.col("dur").alias("gpu_duration"))
    delay = F.greatest(F.col("d_ts") - F.col("h_ts") - F.col("cpu_duration"), F.lit(0))
    return host.join(device, ["rank", "correlation"]).select("rank", "correlation", "cpu_duration", "gpu_duration", delay.alias("launch_delay"))


def launch_outliers(stats: DataFrame, runtime_cutoff: int = 50, delay_cutoff: int = 100) -> DataFrame:
    """Counts by rank: short kernels, slow runtime calls and slow launches."""
    count = lambda c: F.sum(c.cast("long"))
    return stats.groupBy("rank").agg(
        count((F.col("cpu_duration") <= runtime_cutoff) & (F.col("gpu_duration") < F.col("cpu_duration"))).alias("short_kernels"),
        count(F.col("cpu_duration") > runtime_cutoff).alias("runtime_outliers"),
        count(F.col("launch_delay") > delay_cutoff).alias("delay_outliers"),
    )


def operator_kernels(events: DataFrame, width: int, prefix: str = "aten::", same_thread: bool = False) -> DataFrame:
    """Kernel sequences that operators launch, with counts and mean delays.

    A launch belongs to the operator that encloses its start and starts last. An
    operator's first launch sets its delays: launch - operator start and kernel start - launch.
    """
    ops = events.where((F.col("cat") == "cpu_op") & F.col("name").startswith(prefix)).select("rank", "tid", "index", "name", "ts", (F.col("ts") + F.col("dur")).alias("end"))
    launches = events.where((F.col("cat") == "cuda_runtime") & (F.col("correlation") >= 0)).select("rank", "tid", F.col("index").alias("l_index"), "correlation", F.col("ts").alias("l_ts"))
    met = containment_join(launches, ops, ["rank", "tid"] if same_thread else ["rank"], "l_ts", width)
    deepest = met.groupBy("rank", "l_index", "correlation", "l_ts", F.col("tid").alias("l_tid")).agg(F.max_by(F.struct("s_index", "s_name", "s_ts"), F.struct("s_ts", "s_index")).alias("o"))
    kernels = events.where(N.is_gpu_stream()).select("rank", "correlation", F.col("name").alias("kernel"), F.col("ts").alias("k_ts"))
    rows = deepest.join(kernels, ["rank", "correlation"])
    of_op = rows.groupBy("rank", F.col("l_tid"), F.col("o.s_name").alias("aten_op_name"), F.col("o.s_ts").alias("op_ts")).agg(
        F.sort_array(F.collect_list(F.struct("l_ts", "l_index", "kernel", "k_ts"))).alias("all_")
    )
    of_op = of_op.select(
        "aten_op_name", F.array_join(F.col("all_.kernel"), " -> ").alias("kernel_sequence"),
        (F.col("all_")[0]["l_ts"] - F.col("op_ts")).alias("a_"), (F.col("all_")[0]["k_ts"] - F.col("all_")[0]["l_ts"]).alias("b_"),
    )
    return of_op.groupBy("aten_op_name", "kernel_sequence").agg(
        F.count("*").alias("occurrence_count"), F.round(F.avg("a_"), 3).alias("avg_aten_op_launch_delay"), F.round(F.avg("b_"), 3).alias("avg_runtime_delay")
    )


def _least_overlapping(kernels: pa.Table, marks: pa.Table) -> pa.Table:
    """(rank, index, r_dur, r_ts, r_index, r_name) of the least mark by (dur, ts, index) that overlaps each kernel, of one thread's bucket of time.

    Marks are taken from the least on and each gives itself to all kernels it overlaps that have none yet:
    with kernels by start those before its end, of which a tree of the latest ends leads to the ones that end after its start.
    """
    marks = marks.rename_columns([c.removeprefix("m_") for c in marks.column_names])
    order = np.lexsort((marks["index"].to_numpy(), marks["ts"].to_numpy(), marks["dur"].to_numpy()))
    starts, ends = kernels["ts"].to_numpy(), kernels["end"].to_numpy()
    by_start = np.argsort(starts, kind="stable")
    size = 1 << max(0, len(starts) - 1).bit_length()
    least = np.iinfo(np.int64).min
    tree = np.full(2 * size, least)
    tree[size : size + len(starts)] = ends[by_start]
    for level in range(size.bit_length() - 2, -1, -1):
        at = np.arange(1 << level, 2 << level)
        tree[at] = np.maximum(tree[2 * at], tree[2 * at + 1])
    tree = tree.tolist()
    before = np.searchsorted(starts[by_start], marks["end"].to_numpy()[order], side="left").tolist()
    found = np.full(len(starts), -1)
    for mark, start, stop in zip(order.tolist(), marks["ts"].to_numpy()[order].tolist(), before):
        open_ = [(1, 0, size)] if tree[1] > start else []
        while open_:
            node, first, width = open_.pop()
            if first >= stop or tree[node] <= start:
                continue
            if width > 1:
                open_ += [(2 * node, first, width // 2), (2 * node + 1, first + width // 2, width // 2)]
                continue
            found[by_start[first]] = mark
            tree[node] = least
            while node > 1:
                node //= 2
                tree[node] = max(tree[2 * node], tree[2 * node + 1])
        if tree[1] == least:
            break
    met = np.flatnonzero(found >= 0)
    mark = marks.take(found[met])
    return pa.table([*kernels.take(met).select(["rank", "index"]).columns, *mark.select(["dur", "ts", "index", "name"]).columns], names=["rank", "index", "r_dur", "r_ts", "r_index", "r_name"])


def kernels_with_annotation(events: DataFrame, width: int) -> DataFrame:
    """Device rows with user_annotation: the shortest GPU annotation on their pid and tid that overlaps them, null if none.

    Both are listed in time buckets of the given width; no pairs are made, and a task holds a thread's bucket.
    """
    span = lambda df: df.withColumn("end", F.col("ts") + F.col("dur"))
    kernels = span(events.where(N.is_gpu_stream() & (F.col("cat") != "gpu_user_annotation")))
    marks = span(events.where("cat = 'gpu_user_annotation'").select("rank", "pid", "tid", "index", "name", "ts", "dur"))
    listed = lambda df, *columns: df.select("rank", "pid", "tid", buckets(F.col("ts"), F.col("end"), width).alias("bucket_"), "index", "ts", "end", *columns)
    kind = dict(events.dtypes)
    schema = f"rank {kind['rank']}, index {kind['index']}, r_dur {kind['dur']}, r_ts {kind['ts']}, r_index {kind['index']}, r_name string"
    group = ["rank", "pid", "tid", "bucket_"]
    marks = marks.dropna(subset=["rank", "pid", "tid"])  # nulls would meet in a group
    other = listed(marks, "dur", "name")
    other = other.select(*[F.col(c).alias(f"m_{c}") for c in other.columns])
    met = listed(kernels).groupBy(*group).cogroup(other.groupBy(*[f"m_{c}" for c in group])).applyInArrow(_least_overlapping, schema)
    best = met.groupBy(F.col("rank").alias("m_rank"), F.col("index").alias("m_index")).agg(F.min_by("r_name", F.struct("r_dur", "r_ts", "r_index")).alias("user_annotation"))
    return kernels.join(best, (F.col("rank") == F.col("m_rank")) & (F.col("index") == F.col("m_index")), "left").drop("m_rank", "m_index")

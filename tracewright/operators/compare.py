"""Comparisons: of two traces, of ranks, of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def operator_summary(events: DataFrame, device: str = "all") -> DataFrame:
    """(name, cat, counts, total_duration); device is cpu, gpu or all."""
    rows = {"cpu": events.where("stream = -1"), "gpu": events.where("stream <> -1"), "all": events}[device]
    return rows.groupBy("cat", "name").agg(F.count("*").alias("counts"), F.sum("dur").alias("total_duration"))


def extract(events: DataFrame, rank: int | None = None, iteration: int | None = None) -> DataFrame:
    """Rows of a rank and an iteration; by default the first of each."""
    if rank is None:
        events = events.join(F.broadcast(events.agg(F.min("rank").alias("m_"))), F.col("rank") == F.col("m_")).drop("m_")
    else:
        events = events.where(F.col("rank") == rank)
    if iteration is None:
        first = events.where("iteration >= 0").agg(F.min("iteration").alias("m_"))
        return events.join(F.broadcast(first), F.col("iteration") == F.col("m_")).drop("m_")
    return events.where(F.col("iteration") == iteration)


def compare_traces(control: DataFrame, test: DataFrame, device: str = "all") -> DataFrame:
    """Counts and durations by name of both, with differences (test - control) and the sign of the count's: +, - or =."""
    side = lambda df, p: operator_summary(df, device).groupBy("name").agg(F.sum("counts").alias(f"{p}_counts"), F.sum("total_duration").alias(f"{p}_total_duration"))
    both = side(control, "control").join(side(test, "test"), "name", "full").na.fill(0)
    both = both.withColumns({"diff_counts": F.col("test_counts") - F.col("control_counts"), "diff_duration": F.col("test_total_duration") - F.col("control_total_duration")})
    sign = F.when(F.col("diff_counts") > 0, "+").when(F.col("diff_counts") < 0, "-").otherwise("=")
    return both.withColumn("counts_change_categories", sign)


def operator_changes(compared: DataFrame) -> DataFrame:
    """(name, change): added, deleted, increased, decreased or unchanged."""
    c, t, d = F.col("control_counts"), F.col("test_counts"), F.col("diff_counts")
    change = F.when((c == 0) & (t > 0), "added").when((t == 0) & (c > 0), "deleted").when(d > 0, "increased").when(d < 0, "decreased").otherwise("unchanged")
    return compared.select("name", change.alias("change"))


def communication_starts(events: DataFrame, prefix: str = "ncclKernel", least_share: float = 0.01) -> DataFrame:
    """Last communication kernel (by index) of each rank, stream, iteration and name, with its start relative to the earliest one, in mean iteration times.

    Only rows on positive streams in iterations from 1 on, at least least_share of a mean iteration long.
    """
    rows = events.where(N.is_gpu_positive() & (F.col("iteration") > 0))
    span = rows.agg(F.min("ts").alias("t0_"), ((F.max(F.col("ts") + F.col("dur")) - F.min("ts")) / F.count_distinct("iteration")).alias("mean_"))
    comm = rows.where(F.col("name").startswith(prefix)).join(F.broadcast(span)).where(F.col("dur") >= least_share * F.col("mean_"))
    last = comm.groupBy("rank", "stream", "iteration", "name").agg(F.max_by(F.struct("ts", "t0_", "mean_"), "index").alias("e"))
    return last.select("rank", "stream", "iteration", "name", ((F.col("e.ts") - F.col("e.t0_")) / F.col("e.mean_")).alias("start"))


def straggler_metric(starts: DataFrame) -> DataFrame:
    """(stream, name, spread): standard deviation of starts over ranks, averaged over iterations; largest first."""
    each = starts.groupBy("stream", "name", "iteration").agg(F.stddev_samp("start").alias("std"))
    return each.groupBy("stream", "name").agg(F.avg("std").alias("spread"))


def stragglers(starts: DataFrame, k: int = 2) -> DataFrame:
    """(rank, times): in how many iterations a rank is among the k latest (ties included) on the stream and kernel of the largest spread; the k most frequent."""
    chosen = straggler_metric(starts).agg(F.max_by(F.struct("stream", "name"), F.struct("spread", F.negative("stream"), "name")).alias("c"))
    rows = starts.join(F.broadcast(chosen.select(F.col("c.stream").alias("c_s"), F.col("c.name").alias("c_n"))), (F.col("stream") == F.col("c_s")) & (F.col("name") == F.col("c_n")))
    late = rows.withColumn("place", F.rank().over(Window.partitionBy("iteration").orderBy(F.desc("start")))).where(F.col("place") <= k)
    return late.groupBy("rank").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "rank").limit(k)


def profiler_steps(events: DataFrame) -> DataFrame:
    return events.select(N.iteration_of(F.col("name")).alias("step")).where("step >= 0").distinct().orderBy("step")


def anomalies(df: DataFrame, group: list[str], value: str, z: float = 2.0, relative: float = 0.5, least_std: float = 0.1) -> DataFrame:
    """df with mean, std, z_score, relative_diff and is_anomaly within groups of more than one row."""
    within = Window.partitionBy(*group)
    out = df.withColumns({"mean": F.avg(value).over(within), "std": F.greatest(F.stddev_samp(value).over(within), F.lit(least_std)), "n_": F.count("*").over(within)})
    out = out.withColumns({"z_score": (F.col(value) - F.col("mean")) / F.col("std"), "relative_diff": F.when(F.col("mean") != 0, F.abs(F.col(value) - F.col("mean")) / F.abs(F.col("mean")))})
    flag = (F.col("n_") > 1) & ((F.abs("z_score") > z) | (F.coalesce("relative_diff", F.lit(0.0)) > relative))
    return out.withColumn("is_anomaly", flag).drop("n_")

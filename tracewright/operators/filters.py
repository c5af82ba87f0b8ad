"""Filters over events: callables from DataFrame to DataFrame that compose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

Filter = Callable[[DataFrame], DataFrame]


def iteration_filter(iterations: int | list[int]) -> Filter:
    """Rows of the given iterations; unchanged without an iteration column."""
    wanted = [iterations] if isinstance(iterations, int) else iterations
    if not isinstance(wanted, list) or not all(isinstance(i, int) for i in wanted):
        raise TypeError("iterations must be an int or a list of ints")
    return lambda df: df.where(F.col("iteration").isin(wanted)) if "iteration" in df.columns else df


def iteration_index_filter(positions: int | list[int]) -> Filter:
    """Rows of the iterations at positions (from 0) in ascending order of those that occur; -1 is no iteration.

    Unchanged if nothing but -1 occurs; no rows for positions that don't exist.
    """
    wanted = [positions] if isinstance(positions, int) else positions

    def apply(df: DataFrame) -> DataFrame:
        # at most one row for each iteration, so one task orders them
        found = df.select("iteration").where("iteration >= 0").distinct()
        ranked = found.select(F.col("iteration").alias("i_"), (F.row_number().over(Window.orderBy("iteration")) - 1).alias("p_"))
        any_ = found.agg((F.count("*") > 0).alias("any_"))
        chosen = ranked.where(F.col("p_").isin(wanted)).select("i_", F.lit(True).alias("hit_"))
        out = df.join(F.broadcast(any_)).join(F.broadcast(chosen), F.col("iteration") == F.col("i_"), "left")
        return out.where(~F.col("any_") | F.coalesce("hit_", F.lit(False))).select(*df.columns)

    return apply


def first_iteration_filter() -> Filter:
    return iteration_index_filter(0)


def rank_filter(ranks: int | list[int]) -> Filter:
    wanted = [ranks] if isinstance(ranks, int) else list(ranks)
    return lambda df: df.where(F.col("rank").isin(wanted))


def time_range_filter(bounds: tuple[int, int]) -> Filter:
    """Rows that lie within [start, end]."""
    if len(bounds) != 2 or bounds[0] > bounds[1]:
        raise ValueError("bounds must be (start, end) with start <= end")
    return lambda df: df.where((F.col("ts") >= bounds[0]) & (F.col("ts") + F.col("dur") <= bounds[1]))


def name_filter(pattern: str, column: str = "name") -> Filter:
    """Rows whose name matches the pattern from its start."""
    return lambda df: df.where(N.starts_like(column, pattern))


def distinct_name_filter(pattern: str, column: str = "name") -> Filter:
    """The same, with the pattern tried once for each distinct name (for costly patterns over few names)."""

    def apply(df: DataFrame) -> DataFrame:
        matched = df.select(F.col(column).alias("n_")).distinct().where(N.starts_like("n_", pattern))
        return df.join(matched, F.col(column) == F.col("n_"), "left_semi")

    return apply


def query_filter(expression: str) -> Filter:
    return lambda df: df.where(expression)


def zero_duration_filter() -> Filter:
    return query_filter("dur > 0")


def gpu_kernel_filter() -> Filter:
    return lambda df: df.where(N.is_gpu_kernel_or_sync())


def cpu_operator_filter() -> Filter:
    return lambda df: df.where(~F.coalesce(N.is_gpu_kernel_or_sync(), F.lit(False)))


def memcpy_filter(kind: str) -> Filter:
    """Copies of one kind, given as the full event name."""
    return lambda df: df.where((F.col("name") == kind) & (F.col("cat") == "gpu_memcpy"))


def composite_filter(filters: list[Filter]) -> Filter:
    def apply(df: DataFrame) -> DataFrame:
        for f in filters:
            df = df.transform(f)
        return df

    return apply


def find_occurrence(df: DataFrame, name: str, position: int = 0, keys: tuple[str, ...] = ("rank",)) -> DataFrame:
    """The position-th event (from 0; negative from the end) of a name in time order, at most one row for each key."""
    named = df.where(F.col("name") == name)
    order = [F.col("ts"), F.col("index")] if position >= 0 else [F.col("ts").desc(), F.col("index").desc()]
    place = position if position >= 0 else -position - 1
    return named.withColumn("p_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("p_") == place).drop("p_")


def operator_filter(name: str, position: int = 0, relation: str = "under", required: bool = True) -> Filter:
    """CPU rows under, after or before the position-th occurrence of an operator, on its rank and stream.

    Without required, ranks that have no such occurrence stay whole.
    """
    conditions = {
        "under": (F.col("ts") >= F.col("a_ts")) & (F.col("ts") + F.col("dur") <= F.col("a_end")),
        "after": F.col("ts") >= F.col("a_end"),
        "before": F.col("ts") + F.col("dur") <= F.col("a_ts"),
    }
    if relation in ("ancestors", "stack"):
        raise NotImplementedError(relation)

    def apply(df: DataFrame) -> DataFrame:
        anchor = find_occurrence(df, name, position).select(
            F.col("rank").alias("a_rank"), F.col("stream").alias("a_stream"), F.col("ts").alias("a_ts"), (F.col("ts") + F.col("dur")).alias("a_end")
        )
        keep = (F.col("stream") == F.col("a_stream")) & conditions[relation]
        joined = df.join(anchor, F.col("rank") == F.col("a_rank"), "inner" if required else "left")
        return joined.where(keep if required else keep | F.col("a_ts").isNull()).select(*df.columns)

    return apply


def combined_operator_filter(root=None, preceding=None, following=None, gpu: bool = False, depths: tuple[int, int] | None = None) -> Filter:
    """Rows under root, after preceding and before following (each a name, or missing anchors skipped), of some depths; with gpu also their kernels."""

    def apply(df: DataFrame) -> DataFrame:
        out = df
        for name, relation in ((root, "under"), (preceding, "after"), (following, "before")):
            if name is not None:
                out = out.transform(operator_filter(name, 0, relation, required=False))
        if depths is not None and "depth" in df.columns:
            out = out.where(F.col("depth").between(*depths))
        return out.unionByName(matching_kernels(out, df)) if gpu else out

    return apply


def matching_kernels(cpu: DataFrame, events: DataFrame) -> DataFrame:
    """Device rows launched by the runtime rows of cpu."""
    launches = cpu.where(F.col("cat") == "cuda_runtime").select(F.col("rank").alias("l_rank"), F.col("index").alias("l_index"))
    kernels = events.where(F.col("stream") != -1)
    return kernels.join(launches, (F.col("rank") == F.col("l_rank")) & (F.col("index_correlation") == F.col("l_index")), "left_semi")


def iterations(df: DataFrame) -> DataFrame:
    """Distinct iterations from 0 on, ascending."""
    if dict(df.dtypes)["iteration"] not in ("int", "bigint", "smallint", "tinyint"):
        raise TypeError("iteration must be an integer column")
    return df.select("iteration").where("iteration >= 0").distinct().orderBy("iteration")

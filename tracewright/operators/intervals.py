"""Interval operators: merging, sweeps, containment and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import SEGMENT_US, in_segments, running


def merge_intervals(df: DataFrame, keys: list[str], start: str = "ts", end: str = "end", segment: int = SEGMENT_US) -> DataFrame:
    """Disjoint intervals (keys, ts, end) that cover the same times; touching ones merge. Rows with null bounds are left out.

    Scanned in segments of the given length of time, so that one key is many tasks; keys must not be null.
    """
    known = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).alias("ts"), F.col(end).alias("end"))
    order = ["ts", "end"]
    reached = running(in_segments(known, F.floor(F.col("ts") / segment)), keys, order, maxes={"reached_": F.col("end")}, inclusive=False)
    starts = F.when(F.coalesce(F.col("ts") > F.col("reached_"), F.lit(True)), F.col("ts"))
    placed = running(reached, keys, order, maxes={"island_": starts})  # an island is named by its start
    return placed.groupBy(*keys, F.col("island_").alias("ts")).agg(F.max("end").alias("end"))


def covered_time(df: DataFrame, keys: list[str], segment: int = SEGMENT_US) -> DataFrame:
    """(keys, covered, first, last) of the merged intervals."""
    merged = merge_intervals(df, keys, segment=segment)
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("ts")).alias("covered"), F.min("ts").alias("first"), F.max("end").alias("last"))


def overlap_states(df: DataFrame, keys: list[str], bit: Column, segment: int = SEGMENT_US) -> DataFrame:
    """Segments (keys, state, ts, end) of constant state > 0: the sum of bits of the kinds that run. bit names a row's kind; null rows are left out."""
    merged = merge_intervals(df.withColumn("bit_", bit).where("bit_ is not null"), [*keys, "bit_"], segment=segment)
    points = merged.select(*keys, F.expr("stack(2, ts, bit_, end, -bit_) as (at, delta)"))
    steps = points.groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))
    swept = running(steps, keys, ["at"], F.floor(F.col("at") / segment), sums={"state": F.col("delta")}, nexts={"end": F.col("at")})
    return swept.where((F.col("state") > 0) & (F.col("end") > F.col("at"))).select(*keys, "state", F.col("at").alias("ts"), "end")


def buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def containment_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Pairs of a point row and a span row (columns ts, end) with equal keys and ts <= point <= end.

    Spans are listed in every bucket of the given width that they touch, so the
    join is an equi-join; a point meets a span in exactly one bucket. Columns of
    spans get the prefix s_.
    """
    listed = spans.select(*[F.col(c).alias(f"s_{c}") for c in spans.columns], buckets(F.col("ts"), F.col("end"), width).alias("s_bucket_"))
    placed = points.withColumn("bucket_", F.floor(F.col(at) / width))
    same = F.col("bucket_") == F.col("s_bucket_")
    for key in keys:
        same = same & (F.col(key) == F.col(f"s_{key}"))
    return placed.join(listed, same).where((F.col("s_ts") <= F.col(at)) & (F.col(at) <= F.col("s_end"))).drop("bucket_", "s_bucket_")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys whose [ts, end) intervals overlap; columns of right get the prefix r_.

    Both sides are listed in buckets; a pair counts in the bucket of its later
    start only. how is inner, or left: rows of left without partner stay, with nulls.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    numbered = left.withColumn("row_", F.monotonically_increasing_id())
    lefts = numbered.withColumn("bucket_", buckets(F.col("ts"), F.col("end"), width))
    rights = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], buckets(F.col("ts"), F.col("end"), width).alias("r_bucket_"))
    same = (F.col("bucket_") == F.col("r_bucket_")) & (F.col("bucket_") == F.floor(F.greatest("ts", "r_ts") / width))
    for key in keys:
        same = same & (F.col(key) == F.col(f"r_{key}"))
    overlap = (F.col("r_ts") < F.col("end")) & (F.col("ts") < F.col("r_end"))
    met = lefts.join(rights, same & overlap).drop("bucket_", "r_bucket_")
    if how == "left":
        alone = numbered.join(met.select("row_").distinct(), "row_", "left_anti")
        met = met.unionByName(alone, allowMissingColumns=True)
    return met.drop("row_")


def asof_backward(points: DataFrame, values: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """points with, in columns v_*, the latest row of values with equal keys that is not after it in order (values first on ties, of several at one time the largest by value); null if none.

    One window over the union of both; no pairs are made.
    """
    return _asof(points, values, keys, order, value, forward=False)


def asof_forward(points: DataFrame, values: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The same with the earliest row of values that is after the point in order, of several at one time the smallest by value."""
    return _asof(points, values, keys, order, value, forward=True)


def _asof(points: DataFrame, values: DataFrame, keys: list[str], order: list[str], value: list[str], forward: bool) -> DataFrame:
    carried = [c for c in points.columns if c not in keys + order]
    left = points.select(*keys, *order, F.lit(1).alias("side_"), F.struct(*carried).alias("p_") if carried else F.lit(None).alias("p_"), F.lit(None).alias("v_"))
    right = values.select(*keys, *order, F.lit(0).alias("side_"), F.lit(None).alias("p_"), F.struct(*value).alias("v_"))
    both = left.unionByName(right)
    # a frame that ends at the last row is made anew for each row, so the search forward runs backwards
    turned = [F.desc(c) if forward else F.asc(c) for c in (*order, "side_", "v_")]
    within = Window.partitionBy(*keys).orderBy(*turned).rowsBetween(Window.unboundedPreceding, -1 if forward else 0)
    found = F.last("v_", ignorenulls=True).over(within)
    out = both.withColumn("found_", found).where("side_ = 1")
    return out.select(*keys, *order, *[F.col(f"p_.{c}").alias(c) for c in carried], *[F.col(f"found_.{c}").alias(f"v_{c}") for c in value])

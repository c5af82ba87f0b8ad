"""Exact quantiles by selection: counts of distinct values, a running count in segments, and the values where it passes the wanted places. No group is ever held in memory."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running

#: Segments of a group's range of values.
SEGMENTS = 256


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """(keys, names) with the quantiles of value by keys, interpolated linearly between neighbours, like percentile(). Nulls don't count; null keys are keys; NaN is the largest value."""
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = df.select(*keys, F.col(value).cast("double").alias("x_")).where("x_ is not null")
    counts = rows.groupBy(*keys, "x_").agg(F.count("*").alias("n_")).withColumn("key_", named)
    bounds = counts.groupBy("key_").agg(F.min("x_").alias("least_"), F.max(F.when(~F.isnan("x_"), F.col("x_"))).alias("most_"), F.sum("n_").alias("total_"))
    placed = counts.join(bounds, "key_")
    share = (F.col("x_") - F.col("least_")) / (F.col("most_") - F.col("least_"))
    finite = (F.col("most_") > F.col("least_")) & (F.col("most_") < float("inf")) & (F.col("least_") > float("-inf")) & (F.col("most_") - F.col("least_") < float("inf"))
    segment = F.when(F.isnan("x_"), SEGMENTS).when(finite, F.floor(share * SEGMENTS)).otherwise(0)
    counted = running(placed, ["key_"], ["x_"], segment, sums={"upto_": F.col("n_")})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto_") > place, F.col("x_")))

    places = {k: (F.col("total_") - 1) * F.lit(float(q)) for k, q in wanted.items()}
    sides = [f(p).alias(f"{side}_{k}") for k, p in places.items() for side, f in (("lo", lambda p: at(F.floor(p))), ("hi", lambda p: at(F.ceil(p))))]
    found = counted.groupBy(*keys, "key_", "total_").agg(*sides)

    def between(k: str) -> Column:
        p, lo, hi = places[k], F.col(f"lo_{k}"), F.col(f"hi_{k}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(k)

    return found.select(*keys, *[between(k) for k in wanted])


def with_quartiles(df: DataFrame, keys: list[str], value: str, *aggregates: Column) -> DataFrame:
    """(keys, aggregates, q25, q50, q75) of value by keys; quartiles are null where there is no value."""
    quartiles = exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumnsRenamed({k: f"k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return df.groupBy(*keys).agg(*aggregates).join(quartiles, same, "left").drop(*[f"k_{k}" for k in keys])

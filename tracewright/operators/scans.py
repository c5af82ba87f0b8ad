"""Running sums and maxima in two levels, so that the rows of one key are not one task.

A segment column, which never falls in the order of the scan, cuts each key into
pieces. Windows run within segments; a window over one row a segment gives
what all earlier segments come to, and that is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a trace that a segment spans by default: a rank has up to a few million rows in them.
SEGMENT_US = 10_000_000


def in_segments(df: DataFrame, bucket: Column) -> DataFrame:
    """df with the segment of each row, which several scans in the same order can use without another shuffle."""
    return df.withColumn("segment_", bucket)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    bucket: Column | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """df with the running sums and maxima of the given values within keys, and the values of next rows, by name.

    bucket: the segment, by default that of in_segments(), which is kept. order: the
    order of rows; ties between rows that matter must be broken in it. inclusive:
    whether a row's own value counts; if not, the first row has sum 0 and maximum null.
    nexts: values that never fall in the order, of which each row gets its follower's.
    Null values don't count. keys shouldn't be null: rows with a null key see their own segment
    only. The largest task holds one segment of a key, or one row for each segment of a key.
    """
    sums, maxes, nexts = dict(sums or {}), dict(maxes or {}), dict(nexts or {})
    rows = (df if bucket is None else in_segments(df, bucket)).withColumns({f"v_{k}": v for k, v in (sums | maxes | nexts).items()})
    segment = Window.partitionBy(*keys, "segment_").orderBy(*order)
    frame = segment.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = Window.partitionBy(*keys).orderBy("segment_")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    folds = {k: F.sum for k in sums} | {k: F.max for k in maxes} | {k: F.min for k in nexts}
    totals = rows.groupBy(*keys, "segment_").agg(*[f(f"v_{k}").alias(f"t_{k}") for k, f in folds.items()])
    carries = [f(f"t_{k}").over(before).alias(f"c_{k}") for k, f in folds.items() if k not in nexts] + [F.lead(f"t_{k}").over(whole).alias(f"c_{k}") for k in nexts]
    carried = totals.select(*keys, "segment_", *carries)
    local = {f"v_{k}": f(f"v_{k}").over(frame) for k, f in folds.items() if k not in nexts} | {f"v_{k}": F.lead(f"v_{k}").over(segment) for k in nexts}
    met = rows.withColumns(local).join(carried, [*keys, "segment_"], "left")
    zero = F.lit(0)
    done = {k: F.coalesce(f"v_{k}", zero) + F.coalesce(f"c_{k}", zero) for k in sums} | {k: F.greatest(f"v_{k}", f"c_{k}") for k in maxes} | {k: F.coalesce(f"v_{k}", f"c_{k}") for k in nexts}
    kept = [c for c in df.columns if c not in done]
    return met.select(*kept, *[v.alias(k) for k, v in done.items()])

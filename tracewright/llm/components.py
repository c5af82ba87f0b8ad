"""Connected components of an undirected graph by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then that
    label's own label, so that chains shorten by doubling. Labels are kept in
    the shared folder after each round; only a count comes to the driver.
    Joins are merged, as the many small broadcasts of the rounds would be built
    in the driver.
    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    links = edges.where("a <> b").select("a", "b")
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]))
    links = cut(links.select(ends.alias("e")).select("e.a", "e.b").distinct())  # with a loop at each node
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    while True:
        stepped = (
            links.join(labels.hint("merge"), links.b == labels.node)
            .groupBy("a")
            .agg(F.min("component").alias("component"), F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"))
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        now = cut(
            stepped.join(jump.hint("merge"), stepped.component == jump.via).select(
                F.col("a").alias("node"), "was", F.least("component", "far").alias("component")
            )
        )
        labels = now.select("node", "component")
        if now.where("was <> component").isEmpty():
            return labels

"""Dependency graphs: longest paths, and what-if estimates on pipeline schedules."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = ["rank", "direction", "micro_batch", "stage"]


def _knots(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """A number for each node; nodes that reach each other have the same one (Tarjan's search, without recursion)."""
    after: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        after[a].append(b)
    found: dict[int, int] = {}
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    for root in nodes:
        if root in seen:
            continue
        walk = [(root, iter(after[root]))]
        seen[root] = low[root] = len(seen)
        open_.append(root)
        while walk:
            n, left = walk[-1]
            for b in left:
                if b not in seen:
                    seen[b] = low[b] = len(seen)
                    open_.append(b)
                    walk.append((b, iter(after[b])))
                    break
                if b not in found:
                    low[n] = min(low[n], seen[b])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[n])
                if low[n] == seen[n]:
                    while n not in found:
                        found[open_.pop()] = seen[n]
    return found


def _opened(nodes: pd.DataFrame, edges: pd.DataFrame, stuck: set[int]) -> pd.DataFrame:
    """edges without those that close a cycle: of the edges on cycles, which lie between stuck nodes, those that lead back in time (column at), then of cycles at one time those that lead to no larger id."""
    at = dict(zip(nodes["node"].tolist(), nodes["at"].tolist()))
    for closes in (lambda a, b: at[b] < at[a], lambda a, b: (at[b], b) <= (at[a], a)):
        inner = edges["a"].isin(stuck) & edges["b"].isin(stuck)
        pairs = list(zip(edges.loc[inner, "a"].tolist(), edges.loc[inner, "b"].tolist()))
        knot = _knots(sorted(stuck), pairs)
        edges = edges.drop(edges.index[inner][[knot[a] == knot[b] and closes(a, b) for a, b in pairs]])
    return edges


def _longest(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """One graph's longest path (node and edge weights are whole numbers): rows (node, position, reached, tied).

    Kahn's order by smallest id. Of equally long ways the one over the smaller
    predecessor, and of equally late ends the smaller node. tied counts all longest paths.
    Where nodes have a time (column at), edges that close a cycle are left out; else a cycle is an error.
    """
    weight = dict(zip(nodes["node"].tolist(), nodes["weight"].tolist()))
    after: dict[int, list[tuple[int, int]]] = {n: [] for n in weight}
    waiting = dict.fromkeys(weight, 0)
    for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["weight"].tolist()):
        if a in weight and b in weight:
            after[a].append((b, w))
            waiting[b] += 1
    start = dict.fromkeys(weight, 0)
    came: dict[int, int | None] = dict.fromkeys(weight)
    ways = dict.fromkeys(weight, 0)
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    reached: dict[int, int] = {}
    while ready:
        n = heapq.heappop(ready)
        ways[n] = ways[n] or 1
        reached[n] = start[n] + weight[n]
        for b, w in after[n]:
            late = reached[n] + w
            if came[b] is None or late > start[b]:
                start[b], came[b], ways[b] = late, n, ways[n]
            elif late == start[b]:
                ways[b] += ways[n]
                came[b] = min(came[b], n)
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(ready, b)
    if len(reached) < len(weight):
        if "at" not in nodes:
            raise ValueError("the graph has a cycle")
        return _longest(nodes.drop(columns="at"), _opened(nodes, edges, weight.keys() - reached.keys()))
    if not reached:
        return pd.DataFrame({"node": [], "position": [], "reached": [], "tied": []})
    total = max(reached.values())
    ends = sorted(n for n, t in reached.items() if t == total)
    path, n = [], ends[0]
    while n is not None:
        path.append(n)
        n = came[n]
    path.reverse()
    return pd.DataFrame({"node": path, "position": range(len(path)), "reached": [reached[n] for n in path], "tied": float(sum(ways[n] for n in ends))})


def longest_path(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, node, position, reached, tied) for the graph of each key: nodes (key, node, weight, and at, a time, if cycles may be opened), edges (key, a, b, weight).

    One task holds one graph, which is a rank's clipped window or a pipeline group's iteration.
    """
    kind = dict(nodes.dtypes)[key]

    def run(group, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = _longest(own, links)
        out.insert(0, key, group[0])
        return out

    schema = f"{key} {kind}, node long, position long, reached long, tied double"
    links = edges.select(F.col(key).alias("key_"), "a", "b", "weight")
    own = nodes.select(F.col(key).alias("own_"), "node", "weight", *[c for c in ("at",) if c in nodes.columns])
    return own.groupBy("own_").cogroup(links.groupBy("key_")).applyInPandas(run, schema)


def schedule_nodes(steps: DataFrame) -> DataFrame:
    """Steps (group, rank, direction, micro_batch, stage, ts, dur) with node ids by start within the group."""
    order = Window.partitionBy("group").orderBy("ts", *STEP)
    return steps.withColumn("node", F.row_number().over(order).cast("long"))


def schedule_edges(nodes: DataFrame, stages: int, virtual: int) -> DataFrame:
    """(group, a, b, kind): order on a rank, transfers between neighbours and around the ring, and each activation's use."""
    local = Window.partitionBy("group", "rank").orderBy("ts", "node")
    runs = nodes.withColumn("prev_", F.lag("node").over(local)).where("prev_ is not null").select("group", F.col("prev_").alias("a"), F.col("node").alias("b"), F.lit("local").alias("kind"))

    def transfer(kind: str, where, rank, direction: str, to: str, stage) -> DataFrame:
        source = nodes.where((F.col("direction") == direction) & where).select("group", F.col("node").alias("a"), rank.alias("t_rank"), F.lit(to).alias("t_direction"), F.col("micro_batch").alias("t_mb"), stage.alias("t_stage"))
        target = nodes.select(F.col("group").alias("g_"), F.col("node").alias("b"), *STEP)
        same = (F.col("group") == F.col("g_")) & (F.col("rank") == F.col("t_rank")) & (F.col("direction") == F.col("t_direction")) & (F.col("micro_batch") == F.col("t_mb")) & (F.col("stage") == F.col("t_stage"))
        return source.join(target, same).select("group", "a", "b", F.lit(kind).alias("kind"))

    r, v = F.col("rank"), F.col("stage")
    found = [
        transfer("forward", r < stages - 1, r + 1, "forward", "forward", v),
        transfer("forward_wrap", (r == stages - 1) & (v < virtual), F.lit(0), "forward", "forward", v + 1),
        transfer("backward", r > 0, r - 1, "backward", "backward", v),
        transfer("backward_wrap", (r == 0) & (v > 1), F.lit(stages - 1), "backward", "backward", v - 1),
        transfer("activation", F.lit(True), r, "forward", "backward", v),
    ]
    for more in found:
        runs = runs.unionByName(more)
    return runs


def check_steps(steps: DataFrame, stages: int, virtual: int, micro_batches: int) -> DataFrame:
    """Problems (group, rank, direction, micro_batch, stage, problem): steps that are missing or there more than once."""
    spark = steps.sparkSession
    numbers = lambda n, first, name: spark.range(first, first + n).select(F.col("id").cast("int").alias(name))
    directions = spark.createDataFrame([("forward",), ("backward",)], "direction string")
    wanted = steps.select("group").distinct().join(F.broadcast(numbers(stages, 0, "rank"))).join(F.broadcast(directions))
    wanted = wanted.join(F.broadcast(numbers(micro_batches, 0, "micro_batch"))).join(F.broadcast(numbers(virtual, 1, "stage")))
    missing = wanted.join(steps, ["group", *STEP], "left_anti").select("group", *STEP, F.lit("missing").alias("problem"))
    repeated = steps.groupBy("group", *STEP).agg(F.count("*").alias("n")).where("n > 1").select("group", *STEP, F.lit("repeated").alias("problem"))
    return missing.unionByName(repeated)


def violations(nodes: DataFrame, edges: DataFrame, least: float = 1e-6) -> DataFrame:
    """Edges whose target starts before their source ends, with the gap."""
    start = nodes.select("group", F.col("node").alias("b"), F.col("ts").alias("b_ts"))
    end = nodes.select("group", F.col("node").alias("a"), (F.col("ts") + F.col("dur")).alias("a_end"))
    met = edges.join(start, ["group", "b"]).join(end, ["group", "a"]).withColumn("gap", F.col("b_ts") - F.col("a_end"))
    return met.where(F.col("gap") < -least)


def what_if(nodes: DataFrame, edges: DataFrame, threshold: int, target: int, rounds: int = 3, direction: str = "forward") -> list[dict]:
    """Total time, gain and shortened steps of each round: steps of the longest path above a duration are shortened to a target.

    Ends early when a round has nothing to shorten or gains nothing. Only totals
    and the shortened steps of one path come to the driver.
    """
    from pyspark import StorageLevel

    reports, weighed = [], nodes.withColumn("weight", F.col("dur"))
    flat = edges.withColumn("weight", F.lit(0).cast("long")).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for number in range(rounds + 1):
        path = longest_path(weighed, flat, "group").persist(StorageLevel.MEMORY_AND_DISK)
        total = path.agg(F.max("reached")).first()[0]
        report = {"round": number, "total": total, "gain": None if before is None else before - total}
        reports.append(report)
        long_ = path.join(weighed, ["group", "node"]).where((F.col("direction") == direction) & (F.col("weight") > threshold)).select("group", F.col("node").alias("n_"))
        changed = [tuple(r) for r in long_.collect()]
        report["shortened"] = len(changed)
        if not changed or (before is not None and before == total):
            break
        before = total
        marked = nodes.sparkSession.createDataFrame(changed, "g_ " + dict(nodes.dtypes)["group"] + ", n_ long").withColumn("hit_", F.lit(True))
        weighed = weighed.join(F.broadcast(marked), (F.col("group") == F.col("g_")) & (F.col("node") == F.col("n_")), "left")
        weighed = weighed.withColumn("weight", F.when(F.col("hit_"), F.lit(target).cast("long")).otherwise(F.col("weight"))).drop("g_", "n_", "hit_")
    return reports

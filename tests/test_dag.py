import itertools
import random

import pandas as pd
import pytest

from tracewright.operators import dag, parallel
from tracewright.plans import pipeline_fixtures as P


def slow_longest(weights, edges):
    """Length and number of all longest paths by listing every path."""
    after = {n: [(b, w) for a, b, w in edges if a == n] for n in weights}
    found = []

    def walk(n, total):
        total += weights[n]
        if not after[n]:
            found.append(total)
        for b, w in after[n]:
            walk(b, total + w)

    for n in weights:
        if not any(b == n for _, b, _ in edges):
            walk(n, 0)
    return max(found), found.count(max(found))


def test_longest_path_by_all_paths():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(2, 9)
        weights = {i: rng.randrange(1, 4) for i in range(n)}
        edges = [(a, b, rng.randrange(3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        out = dag._longest(pd.DataFrame(weights.items(), columns=["node", "weight"]), pd.DataFrame(edges, columns=["a", "b", "weight"]))
        assert (out["reached"].iloc[-1], out["tied"].iloc[0]) == slow_longest(weights, edges)


def test_cycle_raises():
    with pytest.raises(ValueError):
        dag._longest(pd.DataFrame({"node": [1, 2], "weight": [1, 1]}), pd.DataFrame({"a": [1, 2], "b": [2, 1], "weight": [0, 0]}))


def test_what_if_gains(spark):
    nodes = dag.schedule_nodes(P.steps(spark))
    edges = dag.schedule_edges(nodes, P.STAGES, P.VIRTUAL)
    reports = dag.what_if(nodes, edges, threshold=60_000, target=50_000, rounds=2)
    assert reports[0]["gain"] is None and reports[0]["shortened"] > 0
    assert all(b["total"] <= a["total"] for a, b in itertools.pairwise(reports))
    assert dag.check_steps(P.steps(spark), P.STAGES, P.VIRTUAL, P.MICRO_BATCHES).count() == 0
    assert dag.check_steps(P.steps(spark).where("micro_batch <> 3 or rank <> 1"), P.STAGES, P.VIRTUAL, P.MICRO_BATCHES).count() == 4


def test_groups_and_schedules(spark):
    groups = parallel.rank_groups(spark, {"tp": 2, "dp": 3}, "dp").orderBy("rank").collect()
    assert [(r.group_id, r.pos) for r in groups] == [(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2)]
    with pytest.raises(ValueError):
        parallel.rank_groups(spark, {"tp": 2}, "xx")
    order = sorted(parallel.schedule_order(parallel.schedule_table(spark, 5, 2, 2), 3).collect())
    assert [r.step for r in order] == list(range(20))
    assert {(r.direction, r.micro_batch, r.chunk) for r in order} == {(d, m, c) for d in ("forward", "backward") for m in range(5) for c in range(2)}
    wide = parallel.expert_wide(parallel.expert_statistics(P.steps(spark).withColumn("event", P.F.col("direction")), parallel.rank_groups(spark, {"tp": 4}, "tp")), ["forward", "backward"])
    assert "forward_dur_mean" in wide.columns and wide.count() == P.MICRO_BATCHES

import pytest
from pyspark.sql import functions as F

from tracewright.operators import critical_path as C


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        # rank, index, tid, stream, ts, dur, name, cat, correlation, index_correlation
        (0, 0, 1, -1, 0, 1000, "ProfilerStep#1", "user_annotation", -1, -1),
        (0, 1, 1, -1, 10, 50, "aten::mm", "cpu_op", -1, -1),
        (0, 2, 1, -1, 20, 10, "cudaLaunchKernel", "cuda_runtime", 5, 3),
        (0, 3, 7, 7, 60, 240, "gemm", "kernel", 5, 2),
        (0, 4, 1, -1, 70, 10, "cudaLaunchKernel", "cuda_runtime", 6, 5),
        (0, 5, 7, 7, 310, 100, "ncclKernel_x", "kernel", 6, 4),
        (0, 6, 1, -1, 90, 330, "cudaDeviceSynchronize", "cuda_runtime", 7, 7),
        (0, 7, 7, 7, 95, 320, "Context Sync", "cuda_sync", 7, 6),
        (0, 8, 1, -1, 430, 20, "aten::add", "cpu_op", -1, -1),
        (0, 9, 1, -1, 2000, 20, "later", "cpu_op", -1, -1),
    ]
    return spark.createDataFrame([(*r[:2], 1, *r[2:]) for r in rows], "rank int, index long, pid int, tid int, stream int, ts long, dur long, name string, cat string, correlation long, index_correlation long")


def test_path_over_device_and_back(events):
    window = C.clip(events)
    assert window.where("index = 9").count() == 0
    kinds = {(r.a, r.b): (r.kind, r.weight) for r in C.edges(window).collect()}
    assert kinds[4, 6] == (C.LAUNCH, 40)  # launch start to kernel start
    assert kinds[7, 10] == (C.KERNELS, 10)  # kernel end to the next kernel's start
    assert kinds[11, 13] == (C.SYNC, 0)  # last kernel end to the end of the synchronising call
    assert kinds[12, 13][1] == 0 if (12, 13) in kinds else True
    links = C.edges(window).cache()
    found = C.critical_path(window, links=links).cache()
    assert [r.node for r in found.orderBy("position").collect()] == [2, 4, 6, 7, 10, 11, 13, 16, 17]
    parts = {r.bound_by: r.time for r in C.summary(C.breakdown(window, found, links=links)).collect()}
    assert parts["gpu_compute_bound"] == 240 and parts["gpu_communication_bound"] == 100 and parts["gpu_kernel_launch_overhead"] == 40
    assert C.overlay(window, found).where("event like '%critical_path%'").count() == 16
    loading = C.breakdown(window, found, ["^aten::add"], links)
    assert {r.bound_by for r in loading.where("name = 'aten::add'").collect()} == {"data_loading"}


def test_lock_edges_across_threads(spark):
    calls = [(0, "cudaHostAlloc", 24, 16), (1, "cudaHostAlloc", 18, 12), (2, "cudaLaunchKernel", 21, 24), (3, "cudaLaunchKernel", 48, 7), (4, "aten::clamp_min", 14, 46)]
    host = spark.createDataFrame([(r, i, n, t, d) for r in (0, 1) for i, n, t, d in calls], "rank int, index long, name string, ts long, dur long")
    rows = C.lock_edges(host).collect()
    for rank in (0, 1):
        got = {(r.a, r.b): (r.kind, r.dur) for r in rows if r["rank"] == rank}
        assert got == {
            (2, 3): (C.OPERATOR, 12), (0, 3): (C.DEPENDENCY, 0), (4, 3): (C.DEPENDENCY, 0), (3, 1): (C.DEPENDENCY, 0), (1, 5): (C.DEPENDENCY, 0), (6, 7): (C.OPERATOR, 7),
        }


def test_strict_paths(events):
    window = C.clip(events)
    assert C.edge_problems(window).isEmpty()
    late = window.withColumn("ts", F.when(F.col("index") == 5, F.col("ts") - 200).otherwise(F.col("ts")))
    with pytest.raises(ValueError, match="back in time"):
        C.critical_path(late, strict=True)


def test_merged_threads(spark):
    rows = [(0, 1, 1, "forward x"), (0, 1, 2, "autograd y"), (0, 1, 3, "other")]
    host = spark.createDataFrame(rows, "rank int, pid int, tid int, name string")
    assert sorted(r.tid for r in C.merged_threads(host).collect()) == [1, 1, 3]


def host_rows(spark, *rows):
    """(tid, start, end, name) on one rank."""
    made = [(0, i, 1, t, -1, s, e - s, n, "cuda_runtime" if n.startswith("cuda") else "cpu_op", -1, -1) for i, (t, s, e, n) in enumerate(rows)]
    return spark.createDataFrame(made, "rank int, index long, pid int, tid int, stream int, ts long, dur long, name string, cat string, correlation long, index_correlation long")


def test_time_is_put_down_to_the_innermost_row(spark):
    """A holds B and C, C holds two launches: starts, ends, and the time between siblings."""
    rows = host_rows(spark, (1, 0, 100, "A"), (1, 10, 30, "B"), (1, 60, 90, "C"), (1, 62, 70, "cudaLaunchKernel"), (1, 75, 80, "cudaLaunchKernel"), (1, 120, 130, "D"))
    got = {(r.a, r.b): (r.kind, r["index"], r.weight) for r in C.edges(rows).collect()}
    op = C.OPERATOR
    assert got == {
        (0, 2): (op, 0, 10), (2, 3): (op, 1, 20), (3, 4): (op, 0, 30), (4, 6): (op, 2, 2), (6, 7): (op, 3, 8), (7, 8): (op, 2, 5), (8, 9): (op, 4, 5), (9, 5): (op, 2, 10), (5, 1): (op, 0, 10),
        (1, 10): (C.DEPENDENCY, None, 0), (10, 11): (op, 5, 10),
    }


def test_what_leads_back_in_time_stays_without_weight(spark, events):
    late = C.clip(events).withColumn("ts", F.when(F.col("index") == 5, F.col("ts") - 20).otherwise(F.col("ts")))
    got = {(r.a, r.b): (r.kind, r["index"], r.weight) for r in C.edges(late).collect()}
    assert got[7, 10] == (C.KERNELS, 3, 0)
    path = [r.node for r in C.critical_path(late).orderBy("position").collect()]
    assert path == [2, 4, 6, 7, 10, 11, 13, 16, 17]


def test_context_waits_for_every_stream(spark, events):
    two = C.clip(events).withColumn("stream", F.when(F.col("index") == 3, 9).otherwise(F.col("stream")))
    found = {(r.a, r.b) for r in C.edges(two).where(F.col("kind") == C.SYNC).collect()}
    assert found == {(7, 13), (11, 13)}


def test_launches_without_weight(events):
    more = {(r.a, r.b): r.weight for r in C.edges(C.clip(events), zero_weight_launches=True).where(F.col("kind") == C.LAUNCH).collect()}
    assert more == {(4, 6): 40, (8, 10): 0}


def planted(spark, edges, times):
    points = spark.createDataFrame([(0, n, t) for n, t in times.items()], "rank int, node long, ts long")
    return points, spark.createDataFrame([(0, a, b) for a, b in edges], "rank int, a long, b long")


def test_cycles_are_found_and_named(spark):
    times = {n: 10 * n for n in range(30)} | {40: 50, 41: 50, 42: 50}
    forward = [(n, n + 1) for n in range(29)]
    assert C.cycles(*planted(spark, forward, times)).collect() == []
    # two cycles with a way between, an edge back that closes none, a cycle at one time, a loop
    more = forward + [(8, 5), (15, 12), (40, 41), (41, 42), (42, 40), (25, 25)]
    got = {(r.cycle, r.node) for r in C.cycles(*planted(spark, more, times)).collect()}
    assert got == {(5, n) for n in (5, 6, 7, 8)} | {(12, n) for n in (12, 13, 14, 15)} | {(40, n) for n in (40, 41, 42)} | {(25, 25)}
    harmless = [(n, n + 1) for n in range(0, 20, 2)] + [(9, 2), (15, 4)]
    assert C.cycles(*planted(spark, harmless, times)).collect() == []


def test_cycles_of_random_graphs(spark):
    import random

    r, points, links, want = random.Random(8), [], [], set()
    for rank in range(12):
        times = {n: r.randint(0, 40) for n in range(25)}
        edges = {(r.randrange(25), r.randrange(25)) for _ in range(35)}
        reach = {n: {n} for n in times}
        for _ in times:
            for a, b in edges:
                reach[a] |= reach[b]
        proper = {n: set().union(*[reach[b] for a, b in edges if a == n], set()) for n in times}
        points += [(rank, n, t) for n, t in times.items()]
        links += [(rank, a, b) for a, b in edges]
        want |= {(rank, min(m for m in times if n in reach[m] and m in reach[n]), n) for n in times if n in proper[n]}
    got = C.cycles(spark.createDataFrame(points, "rank int, node long, ts long"), spark.createDataFrame(links, "rank int, a long, b long"))
    assert {tuple(x) for x in got.collect()} == want


def test_path_where_edges_back_in_time_close_cycles(spark, monkeypatch):
    """Cycles of positive weight, at one time, and of a loop are opened; an edge back that closes none stays."""
    times = {n: 10 * n for n in range(8)} | {20: 30, 21: 30}
    links = [(n, n + 1, 10) for n in range(7)] + [(5, 3, 0), (20, 21, 0), (21, 20, 0), (3, 20, 0), (6, 6, 0), (7, 20, 0)]
    points, edges = planted(spark, [x[:2] for x in links], times)
    edges = spark.createDataFrame([(0, *x) for x in links], "rank int, a long, b long, weight long")
    monkeypatch.setattr(C, "nodes", lambda events: events)
    path = [(r.node, r.reached) for r in C.critical_path(points, links=edges).orderBy("position").collect()]
    assert path == [(n, 10 * n) for n in range(8)]


@pytest.mark.parametrize("rows", [20_000])
def test_searches_forward_take_time_in_proportion(spark, rows):
    """One rank's calls and points: with a frame up to the last row, lock_edges() alone had not ended on these in 100 s."""
    import time

    from tracewright.operators.intervals import asof_forward

    calls = spark.range(3 * rows).selectExpr("cast(0 as int) as rank", "id as index", "'cudaLaunchKernel' as name", "5 * id as ts", "cast(7 as bigint) as dur")
    points = calls.select("rank", (F.col("ts") - 2).alias("ts"), "index")
    start = time.time()
    assert C.lock_edges(calls).where("kind = 'operator_kernel'").count() > 0
    met = asof_forward(points, calls.select("rank", "ts", F.col("index").alias("next")), ["rank"], ["ts"], ["next"])
    assert met.where("v_next = index").count() == 3 * rows
    assert time.time() - start < 30


def test_equal_times_take_the_smaller_and_larger_value(spark):
    from tracewright.operators.intervals import asof_backward, asof_forward

    points = spark.createDataFrame([(0, 5)], "rank int, ts long")
    values = spark.createDataFrame([(0, t, i) for t in (4, 6) for i in (3, 1, 2)], "rank int, ts long, index long")
    assert [r.v_index for r in asof_forward(points, values, ["rank"], ["ts"], ["index"]).collect()] == [1]
    assert [r.v_index for r in asof_backward(points, values, ["rank"], ["ts"], ["index"]).collect()] == [3]

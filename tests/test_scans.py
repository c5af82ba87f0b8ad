import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import callstack, counters, intervals
from tracewright.operators.scans import running


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    made = [(r.choice("ab"), r.randint(-500, 3000), r.randint(-9, 9), i) for i in range(600)]
    return sorted(made), spark.createDataFrame(made, "k string, t long, v long, i long").repartition(5).cache()


@pytest.mark.parametrize("width", [1, 37, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_equals_one_pass(rows, width, inclusive):
    want, sums, best = [], {}, {}
    for n, (k, t, v, i) in enumerate(rows[0]):
        s, m = sums.get(k, 0), best.get(k)
        sums[k], best[k] = s + v, v if m is None else max(m, v)
        after = next((x[1] for x in rows[0][n + 1 :] if x[0] == k), None)
        want.append((k, t, v, i, *((sums[k], best[k]) if inclusive else (s, m)), after))
    got = running(rows[1], ["k"], ["t", "v", "i"], F.floor(F.col("t") / width), sums={"s": F.col("v")}, maxes={"m": F.col("v")}, nexts={"n": F.col("t")}, inclusive=inclusive)
    assert sorted(map(tuple, got.collect())) == want


def frame(spark, spans):
    return spark.createDataFrame([(0, i, s, e) for i, (s, e) in enumerate(spans)], "rank int, i long, ts long, end long")


@pytest.mark.parametrize("segment", [1, 50, 10**9])
def test_merging_and_overlap_over_segments(spark, segment):
    r = random.Random(segment)
    spans = [(s, s + r.choice([0, 1, 5, 400])) for s in (r.randint(0, 4000) for _ in range(150))]
    islands = []
    for s, e in sorted(spans):
        if islands and s <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], e)
        else:
            islands.append([s, e])
    df = frame(spark, spans)
    assert sorted([x.ts, x.end] for x in intervals.merge_intervals(df, ["rank"], segment=segment).collect()) == islands
    states = intervals.overlap_states(df, ["rank"], F.when(F.col("i") % 2 == 0, 1).otherwise(2), segment).collect()
    covered = lambda t, kind: any(s <= t < e for i, (s, e) in enumerate(spans) if i % 2 == kind)
    want = {t: covered(t, 0) + 2 * covered(t, 1) for t in range(4500)}
    got = dict.fromkeys(range(4500), 0)
    for x in states:
        got |= dict.fromkeys(range(x.ts, x.end), x.state)
    assert got == want


def test_stacks_don_t_depend_on_segments(spark):
    r = random.Random(9)
    rows, at = [], 0

    def call(start, end, depth):
        rows.append((0, 1, r.choice([1, 2]) if depth == 0 else rows[-1][2], -1, len(rows), start, end - start))
        t = start
        while depth < 5 and end - t > 3 and r.random() < 0.8:
            t += r.randint(0, 2)
            e = r.randint(t, end)
            call(t, e, depth + 1)
            t = e + 1

    for _ in range(40):
        call(at, at + r.randint(0, 60), 0)
        at += 70
    events = spark.createDataFrame(rows, "rank int, pid int, tid int, stream int, index long, ts long, dur long")
    got = [sorted(map(tuple, callstack.call_stacks(events, segment).collect())) for segment in (10, 133, 10**9)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_memory_timeline_of_several_traces(spark):
    rows = [(k, -5, "create", 7, 0) for k in (1, 2)] + [(k, t, "create" if t % 3 else "destroy", t + k, t % 2) for k in (1, 2) for t in range(1, 60)]
    df = spark.createDataFrame(rows, "rank int, t long, action string, numbytes long, category int")
    small, whole = ([tuple(map(str, r)) for r in counters.memory_timeline(df, 2, ["rank"], segment).orderBy("rank", "t").collect()] for segment in (7, 10**9))
    assert small == whole and len(small) == 118
    alone = counters.memory_timeline(df.where("rank = 2"), 2).orderBy("t").collect()
    assert [str(r.sizes) for r in alone] == [s for k, t, s in small if k == "2"]


def test_shortest_annotations_take_no_pairs(spark, monkeypatch):
    """Against all pairs, over several buckets; no join of intervals is made."""
    import random

    from tracewright.operators import intervals, kernels

    monkeypatch.setattr(intervals, "overlap_join", None)
    monkeypatch.setattr(kernels, "overlap_join", None, raising=False)
    rng, rows = random.Random(3), []
    for i in range(300):
        ts, dur = rng.randrange(500), rng.choice([0, 1, 5, 40, 300])
        rows.append((rng.randrange(2), 1, rng.choice([7, 7, None]), i, 7, ts, dur, f"n{i}", rng.choice(["kernel", "gpu_user_annotation"])))
    events = spark.createDataFrame(rows, "rank int, pid int, tid int, index long, stream int, ts long, dur long, name string, cat string")
    marks = [r for r in rows if r[8] != "kernel" and r[2]]
    want = {}
    for r in rows:
        if r[8] == "kernel":
            met = [(m[6], m[5], m[3], m[7]) for m in marks if m[0] == r[0] and m[2] == r[2] and m[5] < r[5] + r[6] and r[5] < m[5] + m[6]]
            want[r[3]] = min(met)[3] if met else None
    for width in (50, 10_000):
        assert {r["index"]: r.user_annotation for r in kernels.kernels_with_annotation(events, width).collect()} == want

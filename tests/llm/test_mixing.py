import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing as M


def slow_targets(sizes):
    """Targets by sharing the excess again until no source is above its limit."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(names)}
    fixed = {}
    while True:
        free = [k for k in names if k not in fixed]
        left, whole = sum(sizes.values()) - sum(fixed.values()), sum(weight[k] for k in free)
        share = {k: left * weight[k] / whole for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return share | fixed
        fixed |= {k: 3.0 * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 300, None: 50}, {"a": 10, "B": 10, "é": 500, "d": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 1000, "d": 900, "e": 3}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def slow_seats(votes, seats):
    given = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda k: (-votes[k] / (2 * given[k] + 1), k))
        given[best] += 1
    return {k: n for k, n in given.items() if n}


@pytest.mark.parametrize("seats", [1, 7, 100])
def test_seats_are_highest_quotients(spark, seats):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 24.0}
    df = spark.createDataFrame([("g", k, v) for k, v in votes.items()], "g string, k string, v double")
    got = {r.k: r.seats for r in M.apportion(df, ["g"], "k", "v", F.lit(seats), F.lit(10**6)).collect()}
    assert got == slow_seats(votes, seats)


def sized(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_ long, doc_id long, source string, size long")


def test_mix_properties(spark):
    rows = [(i, "big", 40 + i % 60) for i in range(600)] + [(1000 + i, "tiny", 30) for i in range(5)] + [(2000 + i, None, i) for i in range(40)]
    rows += [(7, "big", 44), (None, "big", 50), (3000, "empty", 0), (4000, "one", 20_000)]
    out = M.mix(sized(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert r.taken == r.whole * r["size"] + sum(p.to_ - p.from_ for p in r.pieces)
        assert all(0 <= p.from_ < p.to_ <= r["size"] for p in r.pieces)
    assert {k: t for k, (t, _) in by.items()} == pytest.approx(slow_targets({k: sum(r[2] for r in rows if r[1] == k) for k in by}))
    assert all(abs(t - n) <= max(30, 0.02 * t) for t, n in by.values())
    again = M.mix(sized(spark, rows).repartition(3)).collect()
    assert sorted((r.row_, r.taken) for r in again) == sorted((r.row_, r.taken) for r in out)
    assert M.mix(sized(spark, rows).limit(0)).count() == 0


def test_stage_keeps_spacing_and_clashing_columns(spark):
    names = ["hash_", "h_", "times_", "doc_", "part_", "run_", "size", "whole", "pieces", "row_", "block__", "one__", "times"]
    text = "\n".join("  ".join(f"w{k}x{j}" for j in range(7)) for k in range(400))
    rows = [(1, text, "a"), (2, text, "a"), (2, text, "a"), (3, "b " * 900, "b"), (None, "c\td " * 300, None), (5, None, "a"), (6, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(n).alias(n) for n in names])
    out = M.mix_stage(spark, docs, "")
    found = out.collect()
    assert out.columns == docs.columns and found and all(r[n] == n for r in found for n in names)
    assert all(r.text in {1: text, 2: text, 3: "b " * 900, None: "c\td " * 300}[r.doc_id] for r in found)
    assert M.mix_stage(spark, docs.limit(0), "").count() == 0


def test_query_and_stage_agree(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.taken for r in M.op9_mixture(spark, sf).collect()}
    staged = M.mix_stage(spark, docs, sf)
    assert staged.columns == docs.columns
    got = {}
    for r in staged.select("doc_id", M.n_words(staged.text).alias("n")).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("blocks, shard_words", [(50, 2000), (10, 4000)])
def test_targets_are_met_when_all_words_over_blocks_pass_a_shard(spark, monkeypatch, blocks, shard_words):
    monkeypatch.setattr(M, "BLOCKS", blocks)
    monkeypatch.setattr(M, "SHARD_WORDS", shard_words)
    rows = [(i, "abcdef"[i % 6], 20 + i % 50) for i in range(2700)]
    by = {}
    for r in M.mix(sized(spark, rows)).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(n - t) <= 0.02 * t for t, n in by.values()), by


def test_many_seats_are_highest_quotients_from_few_rows(spark):
    votes = {k: float(v) for k, v in zip("abcdefg", (5301, 2400, 2399, 4, 2400, 0.5, 1))}
    df = spark.createDataFrame([("g", k, v) for k, v in votes.items()], "g string, k string, v double")
    for seats in (3, 1999, 6005):
        got = {r.k: r.seats for r in M.apportion(df, ["g"], "k", "v", F.lit(seats), F.lit(10**6)).collect()}
        assert got == slow_seats(votes, seats)
    # as many seats as would never end if each were listed
    assert sum(r.seats for r in M.apportion(df, ["g"], "k", "v", F.lit(10**12), F.lit(10**15)).collect()) == 10**12

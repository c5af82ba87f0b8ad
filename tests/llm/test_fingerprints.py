import hashlib
import re

import pytest

from tracewright.llm import fingerprints as P


def parts(text):
    return set(re.split(P.SEAM, text))


def slow(rows):
    """Result rows by plain sets, for rows (doc_id, text) with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    near = lambda a, b: len(a & b) / len(a | b)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), near(parts(t), parts(edited)), near(parts(t), parts(after)))
    return out


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in df.collect()}


def test_against_sets(spark):
    rows = [
        (5, "a\nb\nc\nd"), (1, None), (2, ""), (9, "é😀\nx\n\n\nx\ny" * 9), (None, "null id\nline"), (12, "a\nb\nc\nd"), (13, "one paragraph only"),
        (40, "\n".join(f"line {k}" for k in range(900))), (41, "\n".join(f"line {k}" for k in range(300, 1500))), (42, "z"),
    ]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, own int, row_ string")
    out = P.compare_with_edits(docs).cache()
    assert result(out) == slow(rows)
    prints = {r.doc_id: r.fingerprint for r in out.collect()}
    assert prints[5] == prints[12] and prints[1] == prints[2] and len(set(prints.values())) == 8


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "c\nd")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.near_next) for r in P.compare_with_edits(docs).collect())
    assert rows == [(1, 0.0), (1, 1.0), (2, 0.0)]
    assert P.compare_with_edits(docs.limit(0)).count() == 0


def test_peeling_recovers_differences(spark):
    rows = [(k, 0, list(range(k)), list(range(k // 2, k + 3))) for k in range(0, 400, 7)]
    pairs = spark.createDataFrame(rows, "row_ long, pair int, own array<bigint>, other array<bigint>")
    got = {r.row_: r.near for r in P.likeness(pairs).collect()}
    want = {k: len(set(a) & set(b)) / len(set(a) | set(b)) for k, _, a, b in rows}
    assert got == pytest.approx(want)


def test_a_retry_shuffles_digests_and_no_cells(spark):
    rows = [(k, 0, list(range(900 + k)), list(range(400, 900))) for k in range(5)]
    left = spark.createDataFrame(rows, "row_ long, pair int, own array<bigint>, other array<bigint>")
    plan = P._attempt(left, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r.row_: (r.done, r.mine, r.theirs) for r in P._attempt(left, 5).collect()}
    assert got == {k: (True, 400 + k, 0) for k in range(5)}


def test_one_line_shares_pieces_with_its_edit(spark):
    line = " ".join(f"the end of day{k} goes on. As it fills a line" for k in range(60))
    docs = spark.createDataFrame([(1, line), (2, "other words " * 300)], "doc_id long, text string")
    near = {r.doc_id: r.near_edited for r in P.compare_with_edits(docs).collect()}
    assert 0.3 < near[1] < 0.7


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert result(P.op10_fingerprints(spark, sf)) == slow(map(tuple, docs))


def test_fingerprints_are_made_from_kept_digests(spark, monkeypatch):
    """What is kept in the shared folder holds digests and no fingerprints, which are several times as long."""
    kept, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: kept.append(df.columns) or real(df))
    docs = spark.createDataFrame([(k, f"line {k}\nshared\nmore {k % 3}") for k in range(20)], "doc_id long, text string")
    rows = P.compare_with_edits(docs).collect()
    assert len(rows) == 20 and all(r.fingerprint and r.edited_fingerprint for r in rows)
    assert any("own" in columns for columns in kept) and not any("fingerprint" in columns or "sketch_own" in columns for columns in kept)

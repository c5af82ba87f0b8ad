import duckdb
import numpy as np
import pytest

from tracewright.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cls long"


def slow(rows, k=5, divisor=50):
    """All pairs, with Python's whole numbers."""
    known = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    found = []
    for n, (q, a) in enumerate(known):
        if q % divisor == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), c) for m, (c, b) in enumerate(known) if m != n]
            found += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def run(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted(map(tuple, T.op11_topk_search(spark, f"{tmp_path}/{name}").collect()))


def test_odd_rows(spark, tmp_path):
    r = np.random.default_rng(3)
    vector = lambda n=8: [float(x) for x in r.normal(size=n).astype(np.float32)]
    hot = vector()
    rows = [(i, vector(), 0, "x", 1) for i in range(120)] + [(i, hot, 0, "x", 1) for i in range(120, 320)]  # a vector with 200 copies
    rows += [(100, vector(), 0, "y", 2), rows[50], rows[50]]  # an id with two vectors, a row three times
    rows += [(None, vector(), 0, "n", 1), (400, None, 0, "n", 1), (450, [1.0, None], 0, "n", 1), (500, [float("nan")], 0, "n", 1), (550, [float("inf")], 0, "n", 1)]
    rows += [(600, [], 0, "e", 1), (650, vector(3), 0, "s", 1), (700, vector(40), 0, "l", 1), (750, [0.0] * 8, 0, "z", 1)]
    got = run(spark, rows, tmp_path, "odd")
    assert got == slow(rows)
    assert len(got) == 5 * sum(1 for i, *_ in rows if i is not None and i % 50 == 0 and i not in (400, 450, 500, 550))


def test_large_components_few_rows_and_none(spark, tmp_path):
    rows = [(0, [3e6, 2e6], 0, "", 0), (1, [4e6, -1e6], 0, "", 0), (50, [-3e6, 5.5], 0, "", 0)]
    assert run(spark, rows, tmp_path, "few") == slow(rows)
    assert run(spark, [], tmp_path, "none") == []


@pytest.mark.parametrize("slices", [1, 3])
def test_other_slices_and_cells(spark, monkeypatch, slices):
    monkeypatch.setattr(T, "CELL_QUERIES", 20)
    monkeypatch.setattr(T, "CELL_VECTORS", 100)
    r = np.random.default_rng(slices)
    rows = [(i, [float(x) for x in np.round(r.normal(size=10) * 2) / 256]) for i in range(400)]  # few values, so many ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vectors.select("vec_id", T.whole_numbers(vectors.embedding).alias("v"))
    got = sorted(map(tuple, T.top_k(vectors, vectors.vec_id % 10 == 0, 7, slices).collect()))
    assert got == slow(rows, 7, 10)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, T.op11_topk_search(spark, sf).select(*columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({T.ORACLE})").fetchall())

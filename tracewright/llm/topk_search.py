"""Exact search for the highest inner products by a three-phase uniform threshold.

Components are dealt over slices, each of which can score a pair of vectors only in
part; a pair's score is the sum of its parts. (1) Every slice gives the best pairs of each query
by its own part, and these few are scored whole: the k-th best score is a safe
cutoff. (2) The cutoff goes out to all slices, and each gives every pair whose part
reaches an equal share of it: a pair below that share everywhere is below the cutoff. (3) What is
known of a pair, and the most that its missing parts can add, rule pairs out; the
missing parts of the others are fetched.

Slices of queries and candidates meet in cells of bounded size, so no side is
ever whole in a task. Equal vectors are one class, searched for and found once, with its
smallest ids: a vector with very many copies makes neither pairs nor ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, table

#: Slices of the components. With two, a share of the cutoff is far out among the parts (of normal components about 0.4 % of the pairs reach it; with four, 8 %).
SLICES = 2
#: Queries and candidates of a cell, about; queries scored at a time within it; what a part is limited to.
CELL_QUERIES, CELL_VECTORS, AT_ONCE, MOST = 1024, 8192, 256, 1 << 61


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def sound(embedding: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & finite


def classes_of(vectors: DataFrame, queries: Column, keep: int) -> DataFrame:
    """(cls, v, ids, asking) for each distinct v of (vec_id, v): its `keep` smallest ids (repeats count), and whether a query has it."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = vectors.withColumn("place", place).where(F.col("place") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = vectors.where(queries).select("v", F.lit(True).alias("asking")).distinct()
    return cut(first.join(asking, "v", "left").na.fill(False, ["asking"]).withColumn("cls", F.monotonically_increasing_id()))


class _Cells:
    """Slices of queries and candidates, dealt over cells (a, g, s)."""

    def __init__(self, classes: DataFrame, slices: int):
        known = classes.agg(F.count("*").alias("n"), F.count_if("asking").alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
        self.slices, self.width = slices, max(1, -(-known.w // slices))
        self.a, self.g = 1 + known.q // CELL_QUERIES, 1 + known.n // CELL_VECTORS
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        parts = classes.select("cls", "asking", "v", numbers(slices).alias("s")).select("cls", "asking", "s", F.slice("v", F.col("s") * self.width + 1, F.lit(self.width)).alias("part"))
        self.queries = parts.where("asking").select("cls", self.row("cls").alias("a"), numbers(self.g).alias("g"), "s", "part")
        # columns of the two sides of a cogroup must not be the same ones
        self.vectors = parts.select(F.col("cls").alias("v_cls"), numbers(self.a).alias("a"), self.column("cls").alias("g"), (F.col("s") + 0).alias("s"), F.col("part").alias("v_part"))

    def row(self, query: str) -> Column:
        return F.pmod(F.xxhash64(query, F.lit("q")), F.lit(self.a)).cast("int")

    def column(self, cls: str) -> Column:
        return F.pmod(F.xxhash64(cls, F.lit("v")), F.lit(self.g)).cast("int")

    def meet(self, left: DataFrame, f, schema: str) -> DataFrame:
        key = ["a", "g", "s"]
        return left.groupBy(*key).cogroup(self.vectors.groupBy(*key)).applyInArrow(f, schema)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Parts as rows; missing components are 0."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths, flat = np.asarray(pc.list_value_length(lists)), np.asarray(pc.list_flatten(lists))
    rows = np.zeros((len(lists), width), np.int64)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


def _size(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def _bounded(exact: np.ndarray) -> np.ndarray:
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b; beyond 2 ** 53 by whole numbers of any size, limited to MOST."""
    if _size(a) * _size(b) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return _bounded(a.astype(object) @ b.astype(object).T)


def pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same, row by row."""
    if _size(a) * _size(b) * a.shape[1] < 1 << 53:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    return _bounded((a.astype(object) * b.astype(object)).sum(axis=1))


def _table(query, cls, s, part) -> pa.Table:
    return pa.table({"query": pa.array(query, pa.int64()), "cls": pa.array(cls, pa.int64()), "s": pa.array(s, pa.int32()), "part": pa.array(part, pa.int64())})


PARTS = "query long, cls long, s int, part long"


def _scores(left: pa.Table, right: pa.Table, width: int, pick):
    """Table of the pairs that pick(parts, rows from, rows to) gives as places, block of queries by block."""
    if not left.num_rows or not right.num_rows:
        return _table([], [], [], [])
    queries, vectors = _matrix(left["part"], width), _matrix(right["v_part"], width)
    q, c, made = np.asarray(left["cls"]), np.asarray(right["v_cls"]), []
    for at in range(0, len(q), AT_ONCE):
        parts = products(queries[at : at + AT_ONCE], vectors)
        i, j = pick(parts, at, at + len(parts))
        made.append((q[at + i], c[j], parts[i, j]))
    query, cls, part = (np.concatenate(x) for x in zip(*made))
    return _table(query, cls, np.full(len(query), left["s"][0].as_py()), part)


def _local_lists(width: int, most: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        def pick(parts: np.ndarray, _from: int, _to: int):
            n = min(most, parts.shape[1])
            best = np.argpartition(parts, parts.shape[1] - n, axis=1)[:, parts.shape[1] - n :]
            return np.repeat(np.arange(len(parts)), n), best.ravel()

        return _scores(left, right, width, pick)

    return f


def _sufficient(width: int, slices: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        # a part reaches tau / slices if it is at least that, rounded up
        share = -(-np.asarray(left["tau"]) // slices)
        return _scores(left, right, width, lambda parts, at, to: np.nonzero(parts >= share[at:to, None]))

    return f


def _fetch(width: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: parts of queries, and pairs without part."""
        pairs = left.filter(pc.is_null(left["part"]))
        if not pairs.num_rows:
            return _table([], [], [], [])
        asked = left.filter(pc.is_valid(left["part"]))
        queries, vectors = _matrix(asked["part"], width), _matrix(right["v_part"], width)
        i, j = (np.asarray(pc.index_in(pairs[k], value_set=of)) for k, of in (("query", asked["query"]), ("cls", right["v_cls"])))
        part = np.concatenate([pair_products(queries[i[x : x + 65536]], vectors[j[x : x + 65536]]) for x in range(0, len(i), 65536)])
        return _table(pairs["query"].combine_chunks(), pairs["cls"].combine_chunks(), np.full(len(i), left["s"][0].as_py()), part)

    return f


def _best(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def _missing(cells: _Cells, pairs: DataFrame) -> DataFrame:
    """PARTS of pairs (query, cls, s), from the slices that hold them."""
    asked = cells.queries.select("a", "g", "s", F.col("cls").alias("query"), "part", F.lit(None).cast("long").alias("cls"))
    wanted = pairs.select(cells.row("query").alias("a"), cells.column("cls").alias("g"), "s", "query", F.lit(None).cast("array<bigint>").alias("part"), "cls")
    return cells.meet(asked.unionByName(wanted), _fetch(cells.width), PARTS)


def best_classes(classes: DataFrame, k: int, slices: int = SLICES) -> DataFrame:
    """(query, cls, score): for each class that a query has the k classes with the highest inner products, ties by the smaller least id."""
    cells = _Cells(classes, slices)
    # 1: local lists, and a cutoff that k whole scores reach
    lists = cells.meet(cells.queries, _local_lists(cells.width, k), PARTS)
    listed = cut(_best(lists, ["query", "s"], [F.desc("part"), F.col("cls")], k).select("query", "cls").distinct())
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s")
    tried = _missing(cells, listed.select("query", "cls", every)).groupBy("query", "cls").agg(F.sum("part").alias("score"))
    cutoff = _best(tried, ["query"], [F.desc("score"), F.col("cls")], k).where(F.col("place") == k).select(F.col("query").alias("cls"), F.col("score").alias("tau"))
    known = cells.queries.join(cut(cutoff), "cls", "left").na.fill(-MOST * slices if slices < 4 else -(1 << 63), ["tau"])
    # 2: every part that reaches its share of the cutoff
    entries = cut(cells.meet(known.select("a", "g", "s", "cls", "part", "tau"), _sufficient(cells.width, slices), PARTS))
    # 3: what cannot reach the k-th best goes, the rest is scored whole
    seen = entries.groupBy("query", "cls").agg(F.sum("part").alias("score"), F.collect_set("s").alias("has"))
    full = seen.where(F.size("has") == slices)
    higher = _best(full, ["query"], [F.desc("score"), F.col("cls")], k).where(F.col("place") == k).select("query", F.col("score").alias("tau2"))
    limits = cutoff.select(F.col("cls").alias("query"), "tau").join(higher, "query", "left").select("query", F.floor((F.col("tau") - 1) / slices).alias("most"), F.greatest("tau", "tau2").alias("least"))
    able = seen.join(limits, "query", "left").where(F.col("most").isNull() | (F.col("score") + (slices - F.size("has")) * F.col("most") >= F.col("least")))
    able = cut(able.select("query", "cls", "score", F.array_except(F.sequence(F.lit(0), F.lit(slices - 1)), "has").alias("lacks")))
    fetched = _missing(cells, able.select("query", "cls", F.explode("lacks").alias("s"))).select("query", "cls", F.col("part").alias("score"))
    scored = able.select("query", "cls", "score").unionByName(fetched).groupBy("query", "cls").agg(F.sum("score").alias("score"))
    least_ids = classes.select("cls", F.col("ids")[0].alias("least_id"))
    return _best(scored.join(least_ids, "cls"), ["query"], [F.desc("score"), F.col("least_id"), F.col("cls")], k).select("query", "cls", "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of vectors (vec_id, v: array of whole numbers) with the highest inner products with each row that `queries` names, itself left out.

    Ties go to the smaller vec_id. Shorter vectors count as ending in zeros. Repeated rows are candidates, and queries, of
    their own. A part of a score beyond 2 ** 61 counts as that.
    """
    classes = classes_of(vectors, queries, k + 1)
    best = cut(best_classes(classes, k + 1, slices))
    rows = best.join(classes.select("cls", "ids"), "cls").select("query", "cls", "score", F.explode("ids").alias("vec_id"))
    first = _best(rows, ["query"], [F.desc("score"), F.col("vec_id"), F.col("cls")], k + 1)
    found = first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "cls"))).alias("found"))
    answers = classes.where("asking").select("v", F.col("cls").alias("query")).join(found, "query")
    asked = vectors.where(queries).select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    own = F.array_position(F.transform("found", lambda x: (x["vec_id"] == F.col("query_id")) & (x["cls"] == F.col("query"))), True) - 1
    others = F.slice(F.filter("found", lambda x, i: i != F.col("own")), 1, k)
    ranked = asked.withColumn("own", own.cast("int")).select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of embeddings with the highest integer inner products for each row whose vec_id is divisible by 50.

    Vectors that are null or hold a null or a non-finite component take no part, nor do rows without vec_id. Vectors
    of other lengths count as ending in zeros; an empty vector scores 0 with all. Very long vectors are dealt over the
    same slices. Ties, repeated rows and very large components are as top_k says. No rows give no rows. Other columns aren't read.
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = rows.where(F.col("vec_id").isNotNull() & sound(F.col("embedding"))).select("vec_id", whole_numbers(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

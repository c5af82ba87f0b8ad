"""Ranked lexical search over an index of documents in shards.

The index has a row for each shard of documents: the shard's terms, and for each
term a run of (document, impact) in compressed sparse rows. The impact of a term
in a document is the integer that its number there and the document's length come
to; a term's weight joins in at the search, as it needs counts over all shards.

A search goes through an item's terms one by one and adds weighted runs to a dense
accumulator over the shard's documents, from which the highest are selected with
exact regard to ties; the shards' best are merged by one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, lower_ascii, remove_table, repeated, table, write_table

#: Terms are runs of digits, letters A to Z and anything beyond ASCII; the second pattern is what parts them.
TERM, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms and documents of a shard, from which on it is closed. A document is never split, so one longer than that has a shard of its own.
SHARD_TERMS, SHARD_DOCS = 150_000, 16_384
#: Items searched for together; blocks of items and terms of items up to which they are broadcast, otherwise dealt over so many groups of shards.
BLOCK_ITEMS, BROADCAST_BLOCKS, BROADCAST_TERMS, GROUPS = 256, 16, 1_000_000, 64
INDEX = "shard long, ids binary, id_known binary, terms array<string>, dfs array<int>, docs binary, impacts binary"


def corpus_size(documents: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM))
    found = documents.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return found.docs, found.terms


def _indexer(n_docs: int, n_terms: int):
    def shard_of(number: int, parts: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        """parts: ids, whether known, terms one after the other, and each term's document within its part."""
        ids, known = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        starts = np.cumsum([0, *[len(p[0]) for p in parts]])
        of = np.concatenate([p[3] + s for p, s in zip(parts, starts)])
        order = np.lexsort((ids, ~known))  # so that of equal scores the first places win
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        coded = pa.chunked_array([p[2] for p in parts], pa.large_string()).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        of = place[of]
        keys, times = np.unique(np.asarray(coded.indices).astype(np.int64) * len(ids) + of, return_counts=True)
        code, doc = np.divmod(keys, len(ids))
        lengths = np.bincount(of, minlength=len(ids))
        m = 100 - 75 + (75 * lengths * n_docs) // max(n_terms, 1)
        impacts = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
        dfs = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int32)
        binary = lambda a, t: pa.array([a.astype(t).tobytes()], pa.binary())
        columns = [pa.array([number]), binary(ids[order], np.int64), binary(known[order], np.bool_), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([dfs], pa.list_(pa.int32())), binary(doc, np.int32), binary(impacts, np.int32)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, terms, docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
            at = 0
            while at < len(texts):  # a batch of long texts is taken in pieces of some MB
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 8 * SHARD_TERMS)))
                lists = pc.split_pattern_regex(pc.ascii_lower(texts[at:to]), BETWEEN)
                found, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
                real = pc.greater(pc.binary_length(found), 0)
                ids = batch.column(0)[at:to]
                parts.append((np.asarray(pc.fill_null(ids, 0)), np.asarray(ids.is_valid()), found.filter(real).cast(pa.large_string()), np.asarray(of.filter(real)).astype(np.int64)))
                terms, docs, at = terms + len(parts[-1][3]), docs + to - at, to
                if terms >= SHARD_TERMS or docs >= SHARD_DOCS:
                    yield shard_of(number, parts)
                    number, parts, terms, docs = number + 1, [], 0, 0
        if parts:
            yield shard_of(number, parts)

    return run


def index(documents: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text), a row for each shard; texts are read twice."""
    used = documents.select(F.col("doc_id").cast("long"), "text")
    return used.mapInArrow(_indexer(*corpus_size(used)), INDEX)


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def term_weights(indexed: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """(term, w) of those of the given distinct terms that the index has."""
    held = indexed.select(F.explode(F.arrays_zip(F.col("terms").alias("t"), F.col("dfs").alias("d"))).alias("x")).select(F.col("x.t").alias("term"), F.col("x.d").alias("d"))
    dfs = held.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("d").alias("df"))
    return dfs.select("term", weight(n_docs, F.col("df")).alias("w"))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones the first places."""
    if len(scores) <= k:
        return np.flatnonzero(scores > 0)
    least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
    above = np.flatnonzero(scores > max(least, 0))
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]) if least > 0 else above


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row]  # noqa: B023, E731
                array = lambda name, kind: np.frombuffer(cell(name).as_buffer() or b"", kind)  # noqa: B023, E731
                ids, known, docs, impacts = array("ids", np.int64), array("id_known", np.bool_), array("docs", np.int32), array("impacts", np.int32)
                ends = np.cumsum(np.asarray(cell("dfs").values), dtype=np.int64)
                items = cell("items").values
                owners, asked = np.asarray(items.field("item")), items.field("asked")
                pairs = pc.list_flatten(asked)
                codes = pc.fill_null(pc.index_in(pairs.field("term"), value_set=cell("terms").values), -1)
                codes, weights, bounds = np.asarray(codes), np.asarray(pairs.field("w")), np.cumsum([0, *np.asarray(pc.list_value_length(asked))])
                made: list[tuple[int, np.ndarray, np.ndarray]] = []
                for at, owner in enumerate(owners):
                    scores = np.zeros(len(ids), np.int64)
                    for code, w in zip(codes[bounds[at] : bounds[at + 1]], weights[bounds[at] : bounds[at + 1]]):
                        if code >= 0:
                            run_ = slice(ends[code - 1] if code else 0, ends[code])
                            scores[docs[run_]] += w * impacts[run_].astype(np.int64)
                    best = _best(scores, k)
                    made.append((owner, best, scores[best]))
                places = np.concatenate([m[1] for m in made])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(owners, [len(m[1]) for m in made])), pa.array(ids[places], mask=~known[places]), pa.array(np.concatenate([m[2] for m in made]))], ["item", "doc_id", "score"]
                )

    return run


def search(indexed: DataFrame, items: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """(item, rank, doc_id, score): the k documents with the highest scores above 0 for each item (item, text) with its own number.

    Of equal scores the smaller doc_id comes first, null last. Blocks of items are broadcast while they
    are few, otherwise every shard group gets them by a shuffle.
    """
    words = items.select("item", F.explode(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
    terms = cut(words.groupBy("item", "term").agg(F.count("*").alias("r")))
    weighed = terms.join(term_weights(indexed, terms.select("term").distinct(), n_docs), "term")
    asked = weighed.groupBy("item").agg(F.collect_list(F.struct("term", (F.col("w") * F.col("r")).alias("w"))).alias("asked"), F.count("*").alias("n"))
    asked = cut(asked)
    block = F.pmod(F.xxhash64("item"), F.lit(1 + asked.count() // BLOCK_ITEMS))
    blocks = cut(asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item", "asked")).alias("items"), F.sum("n").alias("n")))
    few = blocks.agg((F.count("*") <= BROADCAST_BLOCKS) & (F.coalesce(F.sum("n"), F.lit(0)) <= BROADCAST_TERMS)).first()[0]
    groups = 1 if few else GROUPS
    dealt = blocks.select("items", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    met = indexed.withColumn("g", F.pmod(F.hash("shard"), F.lit(groups)) if groups > 1 else F.lit(0)).join(F.broadcast(dealt) if few else dealt, "g")
    found = met.select("ids", "id_known", "terms", "dfs", "docs", "impacts", "items").mapInArrow(_searcher(k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents for each row of items (item_id, text).

    Rows of equal item_id and text have equal answers and are searched for once; an
    item_id with several texts has an answer for each. Repeated documents are documents of their own.
    """
    spark = documents.sparkSession
    asked = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    asked = cut(asked.withColumn("item", F.monotonically_increasing_id()))  # numbers that are kept before they are read
    used = documents.select(F.col("doc_id").cast("long"), "text")
    n_docs, n_terms = corpus_size(used)
    path = write_table(used.mapInArrow(_indexer(n_docs, n_terms), INDEX), "lexical")
    best = cut(search(spark.read.schema(INDEX).parquet(path), asked.select("item", "text"), n_docs, k))
    remove_table(spark, path)
    met = best.join(asked.select("item", "item_id", "times"), "item")
    return repeated(met, "times").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each item of benchmark.

    Null, empty and term-free texts match nothing; a very long text is one document (or one item) like
    others. Null doc_ids come last among equal scores. Without documents or items there are no rows. Other columns aren't read.
    """
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
size AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM words),
d AS (SELECT row, doc_id, 100 - 75 + ((75 * len(terms) * n) // greatest(l, 1)) AS m FROM words, size),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM words) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, n),
asked AS (SELECT item, item_id, term, count(*) AS r FROM (
  SELECT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, * FROM benchmark)) GROUP BY ALL),
scored AS (SELECT item, item_id, row, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN d USING (row) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN (SELECT row, doc_id FROM d) USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

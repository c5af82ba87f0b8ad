"""Near-duplicates by SimHash with an index over byte positions.

Fingerprints of 64 bits that differ in at most d bits agree in at least 8 - d
of their 8 bytes. The index therefore has an entry for every choice of 8 - d
byte positions with the bytes found there: two fingerprints whose tally of
shared positional bytes reaches the guaranteed minimum meet in an entry, and no
posting list of a single byte is ever paired up. Pairs of an entry are verified
bit by bit; a spanning forest of the verified pairs is passed on, as components
need no more.

Entries with more than CROWDED fingerprints are indexed once more by positions
of half a byte: of the 2d halves that the entry leaves free, two fingerprints
that differ in at most d bits share at least d. Such a finer entry leaves 4d
bits free, so it holds at most 65,536 distinct fingerprints at d = 4, whatever
the input.

The pipeline stage asks for more, texts with a similarity of 4/5 or more; it
verifies the pairs found so and completes them; see near_sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._fingerprint import simhash_batch
from ._shared import broadcast_if_small, cut, small_batches, table
from .components import connected_components
from .near_sets import BROADCAST_ROWS, Sets, signed

#: Fingerprints of one index entry from which on the entry is indexed by finer positions.
CROWDED = 1024


def fingerprint(text: Column, words_per_shingle: int = 4) -> Column:
    """The fingerprint as BIGINT (the unsigned value's bits)."""
    return F.arrow_udf(lambda texts: simhash_batch(texts, words_per_shingle), LongType())(text)


def fingerprint_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _byte(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255).cast("bigint"))


def _entries(value: Column, shared: int) -> Column:
    """Index entries: the chosen positions as a bit mask, above the bytes found there."""
    made = []
    for chosen in combinations(range(8), shared):
        entry = F.lit(sum(1 << k for k in chosen)).cast("bigint")
        for k in chosen:
            entry = F.shiftleft(entry, 8).bitwiseOR(_byte(value, k))
        made.append(entry)
    return F.array(*made)


def _forest(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the fingerprints within max_bits of each other; each is compared with those not yet reached."""
    a, b, left = [], [], fps
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                a += [x] * len(found)
                b += found.tolist()
                reached += list(found)
                left = left[~near]
    return a, b


def _forests(met: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Edges (a, b) within the lists of fp by keys."""

    def trees(batches):
        for batch in batches:
            lists = batch.column("fps")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            a, b = [], []
            for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
                more_a, more_b = _forest(values[first:end], max_bits)
                a += more_a
                b += more_b
            sides = [pa.array(np.array(side, np.uint64).view(np.int64)) for side in (a, b)]
            yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    return met.groupBy(*keys).agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps").mapInArrow(trees, "a long, b long")


def _finer(met: DataFrame, shared: int) -> DataFrame:
    """(entry, part, fp) for each choice of half the half bytes that an entry leaves free, with the values found there."""
    free = 8 - shared
    choices = list(combinations(range(2 * free), free))

    def made(batches):
        for batch in batches:
            entries, fps = (batch.column(c).to_numpy() for c in ("entry", "fp"))
            masks = entries >> 8 * shared
            for mask in np.unique(masks).tolist():
                entry, fp = entries[masks == mask], fps[masks == mask].view(np.uint64)
                halves = [(fp >> np.uint64(8 * k + h) & np.uint64(15)).astype(np.int64) for k in range(8) if not mask >> k & 1 for h in (0, 4)]
                for number, chosen in enumerate(choices):
                    part = np.full(len(fp), number, np.int64)
                    for k in chosen:
                        part = part << 4 | halves[k]
                    yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(part), pa.array(fp.view(np.int64))], ["entry", "part", "fp"])

    return met.select("entry", "fp").mapInArrow(made, "entry long, part long, fp long")


def _shared_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, fp) of the lists with several members, with their number n."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, keys)


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) within max_bits (0 to 6) of each other, over chains of such pairs."""
    if not 0 <= max_bits <= 6:
        raise ValueError("max_bits must be 0 to 6")
    shared = 8 - max_bits
    index = prints.select("fp", F.explode(_entries(F.col("fp"), shared)).alias("entry"))
    met = cut(_shared_lists(index, ["entry"]))
    crowded = met.where(F.col("n") > CROWDED).repartition("fp")
    finer = _shared_lists(cut(_finer(crowded, shared)), ["entry", "part"])
    return _forests(met.where(F.col("n") <= CROWDED), ["entry"], max_bits).union(_forests(finer, ["entry", "part"], max_bits)).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """All columns of docs, with fp (BIGINT) and component_id (smallest id reachable over links).

    Null and empty texts have fingerprint zero and link with each other like any
    other. Null ids never become a component_id unless a group has no other.
    Repeated rows stay. An empty table gives no rows. Columns of docs named fp or
    component_id are replaced, fp_ and group dropped. Very long texts have one fingerprint like others.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("fp", "component_id", "fp_", "group")
    marked = docs.withColumn("fp", fingerprint(F.col(text_col), words_per_shingle))
    return with_groups(marked, id_col, max_bits).drop("group")


def with_groups(marked: DataFrame, id_col: str = "doc_id", max_bits: int = 4, groups: DataFrame | None = None) -> DataFrame:
    """component_id and group (a fingerprint of it) for rows that carry their fingerprint fp; marked is read twice. Groups (node, component) of fingerprints replace those of links()."""
    prints = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    groups = connected_components(links(prints.select("fp"), max_bits)) if groups is None else groups
    members = cut(groups.join(prints, F.col("node") == F.col("fp")).select("fp", "component", "least_id"))
    roots = cut(members.groupBy(F.col("component").alias("root")).agg(F.min("least_id").alias("component_id")))
    placed = members.join(broadcast_if_small(roots, BROADCAST_ROWS), F.col("component") == F.col("root")).select(F.col("fp").alias("m_"), "component_id", F.col("component").alias("group_"))
    alone = F.col("m_").isNull()
    found = prints.join(placed, F.col("fp") == F.col("m_"), "left").select(
        F.col("fp").alias("fp_"), F.when(alone, F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("group_", "fp").alias("group")
    )
    return marked.join(cut(found), marked.fp == F.col("fp_")).drop("fp_")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones included. Null and empty texts have fingerprint zero and are linked; very long texts have one fingerprint; no rows give no rows. Other columns aren't read."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    return with_groups(marked).select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def simhash_pairs(sets: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs (a, b) of rows (fp, simhash): each fp with the least of its fingerprint, and the least ones of fingerprints that links() joins."""
    prints = cut(sets.groupBy("simhash").agg(F.min("fp").alias("least")))
    side = lambda k: prints.select(F.col("simhash").alias(f"{k}_"), F.col("least").alias(k)).hint("merge")
    same = sets.join(side("b"), F.col("simhash") == F.col("b_")).select(F.col("fp").alias("a"), "b").where("a <> b")
    linked = links(prints.select(F.col("simhash").alias("fp")), max_bits).withColumnsRenamed({"a": "from_", "b": "to_"})
    linked = linked.join(side("a"), F.col("from_") == F.col("a_")).join(side("b"), F.col("to_") == F.col("b_"))
    return same.union(linked.select("a", "b"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest id stays (of repeated rows of that id, one; of its several texts, one).

    A group is what chains of texts with a similarity of 4/5 or more reach:
    pairs within 4 bits of SimHash are verified on the texts' sets, and the
    exact index of near_sets adds those that SimHash misses. Texts without words, null included, are alike. A null id stays
    only where its group has no other. All columns of docs are kept, whatever
    their names. Very long texts are one shingle set like others. No rows give
    no rows. docs is read several times; what goes is a narrow table of ids,
    broadcast up to BROADCAST_ROWS rows, else joined by a shuffle.
    """
    small_batches(spark)
    sets = Sets(docs.select("doc_id", "text"))
    keys = sets.keys.select("doc_id", "fp", "n")
    grouped = cut(with_groups(keys, groups=sets.components(simhash_pairs(sets.chosen.select("fp", "simhash")))))
    # of a group's texts with its smallest id the one with the least signature stays
    named = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = named.groupBy("group").agg(F.min(F.struct("fp", "doc_id")).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.fp").alias("k_fp"))
    gone = grouped.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("fp") == F.col("k_fp")), "left_anti")
    gone = broadcast_if_small(cut(gone.select(F.col("doc_id").alias("g_id"), F.col("fp").alias("g_fp"))), BROADCAST_ROWS)
    packed = docs.select(F.struct(*docs.columns).alias("row_"))
    same_id = F.col("row_.doc_id").eqNullSafe(F.col("g_id"))
    if keys.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
        return packed.join(gone, same_id, "left_anti").select("row_.*")
    marked = packed.withColumn("fp_", signed(F.col("row_.text"))["fp"])
    left = marked.join(gone, same_id & (F.col("fp_") == F.col("g_fp")), "left_anti")
    return left.withColumn("id_", F.col("row_.doc_id")).dropDuplicates(["id_", "fp_"]).select("row_.*")

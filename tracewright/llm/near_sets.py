"""Texts whose sets of 5-word shingles have a Jaccard similarity of 4/5 or more, found exactly.

Such texts differ in up to 13 bits of their SimHash fingerprints, where shared
bytes guarantee nothing. The pairs that SimHash gives (simhash_dedup) are
therefore verified on the sets and completed here by an exact index.

Two near sets differ in at most a ninth of their sizes' sum, D shingles. Dealt
by hash into K > D parts, they agree in K - D parts at least. So a set's items
are its parts, each with all the shingles found there, and under any one order
of items two near sets share one of the first D + 1. Larger parts come first:
few unrelated texts agree in several shingles at once, however common one
passage is, so lists of items are short where lists of shingles are long.

Each set is compared with the heads of its lists. What then lies in one list
but in different groups is compared within tasks, in cells of two blocks of at most
about BLOCK sets, by sizes and parities (which classes of a set hold an odd
number of shingles); neither ever rules out a near pair. Of the pairs that they
leave only a spanning forest is passed on, whose components are clusters of sets.
The sets of a cluster, made anew from their texts, are compared whole, again
within cells; a pair of groups that are joined already needs no comparison. So
the rows that leave a cell are fewer than its members, however many pairs are near.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._fingerprint import majority, mix64, shingle_set, signature
from ._shared import broadcast_if_small, cut
from .components import connected_components

#: Narrow rows (at most 40 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Words of 64 parity bits that sample the smallest sets; larger sets have 4, 16, ... times as many, so that there is a class for each shingle at least. It bears on cost only.
SAMPLE = 16
#: Sets of a list from which on it is compared in cells of two blocks of this size; shingles of a block where whole sets are held (8 MB).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Columns (long) of pairs of sets with their groups.
PAIR = ["a", "b", "group_a", "group_b"]
PAIR_SCHEMA = ", ".join(f"{c} long" for c in PAIR)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *arrays]))


def _parity(s: np.ndarray, words: int) -> np.ndarray:
    while 64 * words < len(s):
        words *= 4
    return np.packbits((np.bincount(s & (64 * words - 1), minlength=64 * words) & 1).astype(bool)).view(np.int64)


def signed(text: Column) -> Column:
    """STRUCT<fp, m, odd, simhash> of a text's shingle set: signature (equal for equal sets), size, parities and SimHash fingerprint."""
    words = SAMPLE

    def made(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t) for t in texts.to_pylist()]
        odd = [_parity(s, words) for s in sets]
        prints = np.array([majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), _lists(odd), pa.array(prints)], ["fp", "m", "odd", "simhash"])

    return F.arrow_udf(made, "fp long, m long, odd array<bigint>, simhash long")(text)


def shingles(text: Column) -> Column:
    """STRUCT<fp, shingles> of a text's shingle set."""

    def made(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), _lists(sets)], ["fp", "shingles"])

    # else the optimizer would make the sets before the join that picks the texts
    return F.arrow_udf(made, "fp long, shingles array<bigint>").asNondeterministic()(text)


def n_parts(m: int) -> int:
    """The number of parts, a power of two, for pairs whose larger set has m shingles; more than such sets may differ in."""
    most, parts = 2 * m // 9, 1
    while parts < most + 1 + most // 8:
        parts *= 2
    return parts


def set_items(s: np.ndarray) -> np.ndarray:
    """The items (hashes) of a shingle set of which two different sets of similarity 4/5 or more share one."""
    m, out = len(s), [np.empty(0, np.uint64)]
    hashes, largest = mix64(s.view(np.uint64)), 5 * m // 4
    for parts in sorted({n_parts(m), n_parts(largest)}):  # of which no more than one is between: a pair's larger set has m to 5m/4 shingles
        differ = (m + largest) // 9
        if not differ:
            continue  # such sets are near only if equal
        part = s & (parts - 1)
        order, sizes = np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)
        sums, ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[order], dtype=np.uint64))), np.cumsum(sizes)
        items = mix64(sums[ends] - sums[ends - sizes] + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(parts << 32)))
        out.append(items[np.lexsort((items, -sizes))[: differ + 1]])
    return np.concatenate(out).view(np.int64)


def items(text: Column) -> Column:
    """STRUCT<fp, items> of a text's shingle set."""

    def made(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), _lists([set_items(s) for s in sets])], ["fp", "items"])

    # else the optimizer would make the items twice, once more for a filter of empty lists
    return F.arrow_udf(made, "fp long, items array<bigint>").asNondeterministic()(text)


def _folded(odd: list[np.ndarray]) -> np.ndarray:
    """Parities of sets as rows of the narrowest one's width; a wider row folds to a narrower one, as its classes do."""
    words = min(map(len, odd))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in odd]).view(np.uint64)


def _apart(m: np.ndarray, group: np.ndarray, block: np.ndarray | None, odd: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places in a list) of the pairs, of different groups (and blocks, if given), that neither sizes nor parities rule out."""
    left, bits = np.argsort(m, kind="stable"), _folded(odd)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            first, end = np.searchsorted(5 * m[left], 4 * m[x]), np.searchsorted(4 * m[left], 5 * m[x], "right")
            others = left[first:end]
            near = group[others] != group[x]
            if block is not None:
                near &= block[others] != block[x]
            differ = np.bitwise_count(bits[others[near]] ^ bits[x]).sum(axis=1, dtype=np.int64)
            near[near] = 9 * differ <= m[x] + m[others[near]]
            found = others[near]
            if len(found):
                a.append(np.full(len(found), x))
                b.append(found)
                reached += found.tolist()
                left = np.delete(left, first + np.flatnonzero(near))
    return np.concatenate(a), np.concatenate(b)


def _compared(batches):
    """Pairs (a, b), with their groups, that _apart leaves in the lists `sets` of cells; fewer than a list has members."""
    for batch in batches:
        lists, inner = batch.column("sets"), batch.column("inner").to_pylist()
        at, values = lists.offsets.to_numpy(), lists.values
        fp, m, group, block = (values.field(c).to_numpy() for c in ("fp", "m", "group", "block"))
        odd = values.field("odd")
        starts, bits = odd.offsets.to_numpy(), odd.values.to_numpy()
        found = [np.empty((0, 4), np.int64)]
        for one, first, end in zip(inner, at[:-1].tolist(), at[1:].tolist()):
            if end - first < 2:
                continue
            rows = [bits[starts[k] : starts[k + 1]] for k in range(first, end)]
            a, b = _apart(m[first:end], group[first:end], None if one else block[first:end], rows)
            found.append(np.stack((fp[first + a], fp[first + b], group[first + a], group[first + b]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], PAIR)


def _joined(key, cell):
    """Near pairs (a, b) of a cell's sets, with their groups, that connect the groups which near pairs connect; fewer than it has groups."""
    cell = cell.combine_chunks().sort_by("fp")
    fp, block, group = (cell.column(c).to_numpy() for c in ("fp", "block", "group"))
    sets = [x.values.to_numpy() for x in cell.column("shingles")]
    joined = np.unique(group, return_inverse=True)[1]
    m, bits = np.array(list(map(len, sets))), _folded([_parity(s, SAMPLE) for s in sets])
    inner, a, b = key[1].as_py() == key[2].as_py(), [], []
    for k, s in enumerate(sets):
        others = k + 1 + np.flatnonzero((joined[k + 1 :] != joined[k]) & (5 * np.minimum(m[k + 1 :], m[k]) >= 4 * np.maximum(m[k + 1 :], m[k])))
        others = others if inner else others[block[others] != block[k]]
        others = others[9 * np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64) <= m[k] + m[others]]
        for x in others.tolist():
            if joined[x] == joined[k]:
                continue  # by a pair found meanwhile
            shared = len(np.intersect1d(s, sets[x], assume_unique=True))
            if 5 * shared >= 4 * (m[k] + m[x] - shared):
                joined[joined == joined[x]] = joined[k]
                a.append(k)
                b.append(x)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table([pa.array(x) for x in (fp[a], fp[b], group[a], group[b])], PAIR)


def _near(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the Jaccard similarity of two shingle sets is 4/5 or more."""
    out = []
    for x, y in zip(a, b):
        shared = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
        out.append(5 * shared >= 4 * (len(x) + len(y) - shared))
    return pa.array(out, pa.bool_())


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (fp, blocks_, ...), each once for every cell (low, high) of two blocks that its own block takes part in."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks_")).cast("int")).withColumn("with_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    return dealt.withColumns({"low": F.least("block", "with_"), "high": F.greatest("block", "with_")}).drop("blocks_", "with_")


class Sets:
    """The distinct shingle sets of rows (doc_id, text), and the pairs of them that are near."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.keys = cut(rows.select("doc_id", signed(F.col("text")).alias("s")).groupBy("doc_id", "s.fp").agg(F.count("*").alias("n"), F.max("s.m").alias("m"), F.max("s.odd").alias("odd"), F.max("s.simhash").alias("simhash")))
        # of texts with equal sets the one of the smallest id is read
        self.chosen = cut(self.keys.where("m > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "m", "odd", "simhash")).alias("c")).select("fp", "c.doc_id", "c.m", "c.odd", "c.simhash"))
        self.repeated = not self.keys.where("n > 1").isEmpty()

    def _read(self, wanted: DataFrame) -> DataFrame:
        """(fp, shingles) once for each fp of wanted, made from the chosen texts."""
        some = cut(wanted.join(self.chosen.select("fp", "doc_id").hint("merge"), "fp").select(F.col("fp").alias("f_"), F.col("doc_id").alias("i_")))
        some = broadcast_if_small(some, BROADCAST_ROWS)
        texts = self.rows.join(some, F.col("doc_id").eqNullSafe(F.col("i_"))).select("f_", shingles(F.col("text")).alias("s")).where("f_ = s.fp").select("s.fp", "s.shingles")
        return texts.dropDuplicates(["fp"]) if self.repeated else texts

    def _posted(self) -> DataFrame:
        """(s, fp, head) of the items' lists with several members; head is the list's least fp."""
        copies = self.keys.where("m > 0").join(self.chosen.select(F.col("fp").alias("f_"), F.col("doc_id").alias("i_")), (F.col("fp") == F.col("f_")) & F.col("doc_id").eqNullSafe(F.col("i_")), "left_anti")
        copies = broadcast_if_small(cut(copies.select(F.col("fp").alias("f_"), F.col("doc_id").alias("i_"))), BROADCAST_ROWS)
        made = self.rows.select("doc_id", items(F.col("text")).alias("p")).select("doc_id", "p.fp", "p.items")
        made = made.join(copies, (F.col("fp") == F.col("f_")) & F.col("doc_id").eqNullSafe(F.col("i_")), "left_anti")
        made = made.dropDuplicates(["fp"]) if self.repeated else made
        of_list = Window.partitionBy("s")
        posted = made.select("fp", F.explode("items").alias("s")).withColumns({"head": F.min("fp").over(of_list), "last": F.max("fp").over(of_list)})
        return cut(posted.where("head < last").select("s", "fp", "head"))

    def _across(self, placed: DataFrame) -> DataFrame:
        """Near pairs (a, b), with their groups, that connect the groups of placed (s, fp, head, group) which near pairs within lists connect; heads were compared before."""
        of_list = Window.partitionBy("s")
        mixed = placed.withColumns({"g_": F.min("group").over(of_list), "h_": F.max("group").over(of_list), "size_": F.count("*").over(of_list)})
        mixed = mixed.where("g_ <> h_ and fp <> head").withColumn("blocks_", F.ceil(F.col("size_") / BLOCK).cast("int"))
        sides = self.chosen.select(F.col("fp").alias("f_"), "m", "odd").hint("merge")
        members = _dealt(mixed.select("s", "fp", "group", "blocks_")).join(sides, F.col("fp") == F.col("f_"))
        cells = members.groupBy("s", "low", "high").agg(F.collect_list(F.struct("fp", "m", "group", "block", "odd")).alias("sets"))
        possible = cut(cells.select((F.col("low") == F.col("high")).alias("inner"), "sets").mapInArrow(_compared, PAIR_SCHEMA))
        # a possible pair's sets are in one of these clusters, and each set in no more than one, however many lists it is in
        clusters = connected_components(possible)
        ends = F.explode(F.array(*[F.struct(F.col(k).alias("f_"), F.col(f"group_{k}").alias("group")) for k in "ab"]))
        groups = possible.select(ends.alias("e")).select("e.f_", "e.group").distinct().hint("merge")
        sizes = self.chosen.select(F.col("fp").alias("i_"), "m").hint("merge")
        of_cluster = Window.partitionBy("component")
        inside = clusters.join(groups, F.col("node") == F.col("f_")).join(sizes, F.col("node") == F.col("i_"))
        blocks = F.greatest(F.ceil(F.count("*").over(of_cluster) / BLOCK), F.ceil(F.sum("m").over(of_cluster) / BLOCK_SHINGLES)).cast("int")
        inside = cut(inside.select("component", F.col("node").alias("fp"), "group", blocks.alias("blocks_")))
        sets = cut(self._read(inside.select("fp"))).select(F.col("fp").alias("f_"), "shingles").hint("merge")
        members = _dealt(inside).join(sets, F.col("fp") == F.col("f_")).select("component", "low", "high", "fp", "group", "block", "shingles")
        return cut(members.groupBy("component", "low", "high").applyInArrow(_joined, PAIR_SCHEMA))

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that neither the sets' sizes nor their parities rule out."""
        side = lambda k: self.chosen.select(F.col("fp").alias(k), F.col("m").alias(f"{k}_m"), F.col("odd").alias(f"{k}_odd")).hint("merge")
        both = pairs.where("a <> b").join(side("a"), "a").join(side("b"), "b")
        each = F.zip_with("a_odd", "b_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        differ = F.when(F.size("a_odd") == F.size("b_odd"), F.aggregate(each, F.lit(0), lambda x, y: x + y)).otherwise(0)
        sized = 5 * F.least("a_m", "b_m") >= 4 * F.greatest("a_m", "b_m")
        return both.where(sized & (9 * differ <= F.col("a_m") + F.col("b_m"))).select("a", "b")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are near."""
        pairs = cut(self._possible(pairs.distinct()))
        sets = cut(self._read(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()))
        side = lambda k: sets.select(F.col("fp").alias(f"{k}_"), F.col("shingles").alias(f"{k}_set")).hint("merge")
        both = pairs.join(side("a"), F.col("a") == F.col("a_")).join(side("b"), F.col("b") == F.col("b_"))
        return cut(both.where(F.arrow_udf(_near, "boolean")("a_set", "b_set")).select("a", "b"))

    def components(self, candidates: DataFrame) -> DataFrame:
        """(node, component) of the signatures that chains of near pairs connect; candidates are pairs (a, b) to verify beside those of sets and heads."""
        posted = self._posted()
        edges = self._verified(candidates.select("a", "b").union(posted.select(F.col("fp").alias("a"), F.col("head").alias("b"))))
        labels = connected_components(edges).select(F.col("node").alias("f_"), F.col("component").alias("group_"))
        placed = posted.join(labels.hint("merge"), F.col("fp") == F.col("f_"), "left").select("s", "fp", "head", F.coalesce("group_", "fp").alias("group"))
        joined = connected_components(self._across(placed).select(F.col("group_a").alias("a"), F.col("group_b").alias("b")))
        joined = joined.select(F.col("node").alias("j_"), F.col("component").alias("root_")).hint("merge")
        groups = labels.join(joined, F.col("group_") == F.col("j_"), "left").select(F.col("f_").alias("node"), F.coalesce("root_", "group_").alias("component"))
        # a set that was in no group is one by itself
        alone = joined.join(labels.hint("merge"), F.col("j_") == F.col("f_"), "left_anti").select(F.col("j_").alias("node"), F.col("root_").alias("component"))
        return cut(groups.union(alone))

"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A document's distinct paragraphs are hashed to 64-bit digests; each digest goes
into HASHES cells of one page of the sketch. A cell holds a count, the XOR of
its digests and the XOR of their checks. Subtracting two sketches cell by cell
leaves the paragraphs that differ; cells with a single digest left are peeled
until all are empty. If a page can't be peeled, the pair is tried again with
more pages (other cells), until every pair is recovered.

Paragraphs are lines, cut further at seams that lie in the words themselves
(SEAM), so that an edit changes the pieces it touches and no others and a text
of one line still has pieces to share.

All of it is DataFrame functions. Texts move once, and the opening half of the
next document once more. Sketches are built, subtracted and peeled within the
row; only pairs that IN_ROW tries leave open, those of long texts, go on as rows
of single cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, repeated, table

#: Cells of a page, in HASHES parts of equal size; each digest has a cell in each part.
HASHES = 3
PART = 12
CELLS = HASHES * PART
#: Rounds of peeling within a page; each empties all cells that hold one digest.
ROUNDS = 14
#: Pages of the first try are 1; each further try has so many times as many.
MORE = 4
#: Tries that are made within the row (of 1, 4 and 16 pages).
IN_ROW = 3
#: Pieces end with lines, and at the blanks after a mark and before these letters, about one blank in 30 of European prose.
SEAM = r"[\n ](?:(?<=\n)|(?<=[.!?:;|] )(?=[a-fA-F]))"


def digests(text: Column) -> Column:
    """ARRAY<BIGINT> of the distinct paragraphs' digests. A null is an empty text, which has one empty paragraph."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), SEAM), lambda p: F.xxhash64(p)))


def _cells(digest: str, level: int) -> str:
    """SQL of the digest's cells at a level of retrying, as ARRAY<INT>, one in each part."""
    return "array(" + ", ".join(f"cast(pmod(xxhash64({digest}, {level}, {k}), {PART}) + {k * PART} as int)" for k in range(HASHES)) + ")"


def _page(digest: str, level: int) -> str:
    """SQL of the digest's page at a level."""
    return f"cast(pmod(xxhash64({digest}, {level}, 'page'), {MORE**level}) as int)"


def _sketch(found: str, level: int = 0) -> str:
    """SQL of one page, ARRAY<STRUCT<n, key, check>> of CELLS cells, for an array of digests."""
    places = ", ".join(f"cast(pmod(xxhash64(d, {level}, {k}), {PART}) as int) as c{k}" for k in range(HASHES))
    entries = f"transform({found}, d -> struct({places}, d as key, xxhash64(d, 'check') as check))"
    held = """struct(cast(size(mine) as bigint) as n, aggregate(mine, 0L, (x, e) -> x ^ e.key) as key,
        aggregate(mine, 0L, (x, e) -> x ^ e.check) as check)"""
    part = f"transform(sequence(0, {PART - 1}), i -> transform(array(filter(listed, e -> e.c{{}} = i)), mine -> {held})[0])"
    return f"transform(array({entries}), listed -> concat({', '.join(part.format(k) for k in range(HASHES))}))[0]"


def sketch_text(sketch: str) -> Column:
    """A sketch column as count:key:check of each cell in hex.

    Cells are joined by a comma, empty ones left empty. Equal sets of digests
    give equal texts.
    """
    shown = "if(c.n = 0, '', concat_ws(':', hex(c.n), hex(c.key), hex(c.check)))"
    return F.expr(f"lower(array_join(transform({sketch}, c -> {shown}), ','))")


def _difference(own: str, other: str) -> str:
    """SQL of the cells, ARRAY<STRUCT<cell, n, key, check>>, in which two pages differ."""
    both = f"zip_with({own}, {other}, (a, b) -> struct(a.n - b.n as n, a.key ^ b.key as key, a.check ^ b.check as check))"
    return f"filter(transform({both}, (c, i) -> struct(i as cell, c.n as n, c.key as key, c.check as check)), c -> c.n <> 0 or c.key <> 0)"


def _peeled(cells: str, level: int) -> str:
    """SQL that peels one page's cells, ARRAY<STRUCT<cell, n, key, check>>; STRUCT<cells (those left), plus, minus (digests recovered)>."""
    single = "filter(state.cells, c -> abs(c.n) = 1 and c.check = xxhash64(c.key, 'check'))"
    keys = f"array_distinct(transform({single}, c -> struct(c.key as key, c.n as n)))"
    less = "struct(c.cell as cell, c.n - f.n as n, c.key ^ f.key as key, c.check ^ xxhash64(f.key, 'check') as check)"
    without = f"transform(array({_cells('f.key', level)}), at -> transform(cells, c -> if(array_contains(at, c.cell), {less}, c)))[0]"
    left = f"filter(aggregate(found, state.cells, (cells, f) -> {without}), c -> c.n <> 0 or c.key <> 0)"
    of = lambda sign: f"transform(filter(found, f -> f.n = {sign}), f -> f.key)"
    after = f"struct({left} as cells, concat(state.plus, {of(1)}) as plus, concat(state.minus, {of(-1)}) as minus)"
    none = "cast(array() as array<bigint>)"
    return f"""aggregate(sequence(1, {ROUNDS}), struct({cells} as cells, {none} as plus, {none} as minus),
        (state, turn) -> transform(array({keys}), found -> if(size(found) = 0, state, {after}))[0])"""


_COUNTS = "struct({} as done, cast({} as bigint) as mine, cast({} as bigint) as theirs)"


def with_tries(df: DataFrame, own: str, others: dict[str, str]) -> DataFrame:
    """df with a column STRUCT<done, mine, theirs> for each (other digests column: name), by IN_ROW tries within the row at most.

    mine and theirs count the digests that only one side has. A try is left out
    where an earlier one recovered all, or where the sets' sizes alone differ by
    more digests than its cells can hold. df has the sketches of all digests
    columns, named sketch_ and the column's name.
    """
    df = df.withColumns({name: F.expr(_COUNTS.format("false", 0, 0)) for name in others.values()})
    for level in range(IN_ROW):
        page = lambda found, level=level: _sketch(f"filter({found}, d -> {_page('d', level)} = p)", level) if level else f"sketch_{found}"
        for other, name in others.items():
            due = f"not {name}.done and abs(size({own}) - size({other})) <= {CELLS * MORE**level}"
            pages = f"transform(sequence(0, {MORE**level - 1}), p -> {_difference(page(own), page(other))})"
            counts = _COUNTS.format("size(s.cells) = 0", "size(s.plus)", "size(s.minus)")
            summed = _COUNTS.format("x.done and y.done", "x.mine + y.mine", "x.theirs + y.theirs")
            tried = f"aggregate(transform(pages_, cells -> transform(array({_peeled('cells', level)}), s -> {counts})[0]), {_COUNTS.format('true', 0, 0)}, (x, y) -> {summed})"
            df = df.withColumn("pages_", F.expr(f"if({due}, {pages}, null)")).withColumn(name, F.expr(f"coalesce({tried}, {name})")).drop("pages_")
    return df


def with_sketches(df: DataFrame, *found: str) -> DataFrame:
    return df.withColumns({f"sketch_{c}": F.expr(_sketch(c)) for c in found})


def _attempt(pairs: DataFrame, level: int) -> DataFrame:
    """(row_, pair, done, mine, theirs) for pairs (row_, pair, own, other) whose sketches differ, from rows of single cells; equal sketches give no row. Only the digests are shuffled: a pair's cells are made, summed and peeled where its row lies."""
    pairs = pairs.select("row_", "pair", "own", "other").repartition("row_", "pair")
    sides = F.expr("concat(transform(own, d -> struct(true as own, d)), transform(other, d -> struct(false as own, d)))")
    put = pairs.select("row_", "pair", F.explode(sides).alias("s")).select(
        "row_", "pair", F.expr(_page("s.d", level)).alias("page"), F.col("s.own").alias("own"), F.col("s.d").alias("key"), F.explode(F.expr(_cells("s.d", level))).alias("cell"),
    )
    check, sign = F.xxhash64("key", F.lit("check")), F.when(F.col("own"), 1).otherwise(-1)
    cells = put.groupBy("row_", "pair", "page", "cell").agg(F.sum(sign).alias("n"), F.bit_xor("key").alias("key"), F.bit_xor(check).alias("check"))
    differ = cells.where("n <> 0 or key <> 0").select("row_", "pair", "page", F.struct("cell", "n", "key", "check").alias("c"))
    peeled = differ.groupBy("row_", "pair", "page").agg(F.collect_list("c").alias("cells")).select("row_", "pair", F.expr(_peeled("cells", level)).alias("p"))
    peeled = peeled.select("row_", "pair", (F.size("p.cells") == 0).alias("done"), F.size("p.plus").alias("mine"), F.size("p.minus").alias("theirs"))
    return peeled.groupBy("row_", "pair").agg(F.min("done").alias("done"), F.sum("mine").alias("mine"), F.sum("theirs").alias("theirs"))


def likeness(pairs: DataFrame) -> DataFrame:
    """(row_, pair, near) for pairs (row_, pair, own, other) of digest arrays: shared over all distinct paragraphs, from peeled sketches.

    Tries within the row come first; the pairs they leave go on with MORE times
    the pages each time, as long as there are any. Two empty arrays are alike.
    """
    tried = cut(with_tries(with_sketches(pairs, "own", "other"), "own", {"other": "t_"}))
    shared = F.size("own") - F.col("t_.mine")
    return tried.where("t_.done").select("row_", "pair", _near(shared, F.size("own"), F.size("other"))).union(_retried(tried.where("not t_.done").select("row_", "pair", "own", "other")))


def _near(shared: Column, own: Column, other: Column) -> Column:
    return F.when(own + other > shared, shared / (own + other - shared)).otherwise(1.0).alias("near")


def _retried(left: DataFrame) -> DataFrame:
    """(row_, pair, near) for the pairs that the tries within the row have left."""
    out, level = [left.select("row_", "pair", F.lit(0.0).alias("near")).limit(0)], IN_ROW
    while not left.isEmpty():
        result = _attempt(left, level).withColumnsRenamed({"row_": "r_", "pair": "q_"})
        both = cut(left.join(result, (F.col("row_") == F.col("r_")) & (F.col("pair") == F.col("q_")), "left"))
        done = F.coalesce("done", F.lit(True))
        shared = F.size("own") - F.coalesce("mine", F.lit(0))
        out.append(both.where(done).select("row_", "pair", _near(shared, F.size("own"), F.size("other"))))
        left, level = both.where(~done).select("row_", "pair", "own", "other"), level + 1
    return reduce(DataFrame.union, out)


def followers(ids: DataFrame) -> DataFrame:
    """Distinct rows (id_, h_, ...) with next_id, next_h in ascending order of (id_, h_), nulls first, the last followed by the first.

    Rows are ranged into buckets; only each bucket's first row is compared
    across buckets.
    """
    placed = cut(ids.repartitionByRange("id_", "h_").withColumn("b_", F.spark_partition_id()))
    within = Window.partitionBy("b_").orderBy("id_", "h_")
    firsts = placed.groupBy("b_").agg(F.min(F.struct("id_", "h_")).alias("f_"))
    order = Window.partitionBy().orderBy("b_")
    after = firsts.select(
        F.col("b_").alias("c_"), F.coalesce(F.lead("f_").over(order), F.first("f_").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then_")
    )
    return (
        placed.withColumn("n_", F.lead(F.struct("id_", "h_")).over(within))
        .join(F.broadcast(after), F.col("b_") == F.col("c_"))  # one row for each shuffle partition
        .withColumn("n_", F.coalesce("n_", "then_"))
        .select(*ids.columns, F.col("n_.id_").alias("next_id"), F.col("n_.h_").alias("next_h"))
    )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of docs.

    The edited text has its last half replaced by the opening of the next
    document in ascending order of id, nulls first; the last is followed by the
    first. Rows of one id are ordered by their texts' hashes. Null texts are
    empty. Repeated rows follow each other, so all but the last are their own
    next document. Other columns of docs are not used. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id_"), text.alias("text_")).withColumn("h_", F.xxhash64("text_"))
    listed = rows.withColumn("own", digests(F.col("text_")))
    counted = rows.groupBy("id_", "h_").agg(F.count("*").alias("copies"), F.max(F.length("text_")).alias("size"))
    ids = cut(followers(counted))
    if not ids.where("copies > 1").isEmpty():
        listed = listed.dropDuplicates(["id_", "h_"])
    before = ids.select(F.col("next_id").alias("id_"), F.col("next_h").alias("h_"), F.col("id_").alias("to_id"), F.col("h_").alias("to_h"), F.col("size").alias("to_size"))
    same = F.col("d.id_").eqNullSafe(F.col("b.id_")) & (F.col("d.h_") == F.col("b.h_"))
    opening = (
        listed.alias("d").join(before.alias("b"), same)
        .select(
            F.col("to_id"), F.col("to_h"), F.expr("left(text_, cast(floor(to_size / 2) as int))").alias("opening"), F.col("own").alias("next_digests"),
        )
    )
    own = listed.alias("d").join(ids.select("id_", "h_", "copies", "size").alias("b"), same).select("d.id_", "d.h_", "text_", "own", "copies", "size")
    both = own.join(opening, own.id_.eqNullSafe(opening.to_id) & (own.h_ == opening.to_h))
    first_half = lambda of: F.expr(f"concat(left(text_, size - cast(floor(size / 2) as int)), {of})")
    kept = both.select(
        "id_", "h_", "size", "copies", "own",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(1).cast("bigint").alias("times"), first_half("opening").alias("edited"), F.col("next_digests").alias("next"))),
                F.when(
                    F.col("copies") > 1,
                    F.array(F.struct((F.col("copies") - 1).alias("times"), first_half("left(text_, cast(floor(size / 2) as int))").alias("edited"), F.col("own").alias("next"))),
                ).otherwise(F.array().cast("array<struct<times:bigint,edited:string,next:array<bigint>>>")),
            )
        ).alias("v"),
    )
    table_ = kept.select(
        F.monotonically_increasing_id().alias("row_"), "id_", "size", "own", F.col("v.times").alias("times"), F.sha2("v.edited", 256).alias("edited_sha256"),
        digests(F.col("v.edited")).alias("edited"), F.col("v.next").alias("next"),
    )
    tried = with_tries(with_sketches(table_, "own", "edited", "next"), "own", {"edited": "to_edited", "next": "to_next"})
    near = lambda t, other: F.when(F.col(f"{t}.done"), _near(F.size("own") - F.col(f"{t}.mine"), F.size("own"), F.size(other)))
    shown = {"near_edited": near("to_edited", "edited"), "near_next": near("to_next", "next")}
    # digests are kept and fingerprints made anew from them, which are several times as long
    table_ = cut(tried.withColumns(shown).select(
        "row_", "id_", "size", "times", "edited_sha256", "near_edited", "near_next", "to_edited", "to_next", "own", "edited",
        F.when(~F.col("to_next.done"), F.col("next")).alias("next"),
    ))
    open_ = table_.where("not (to_edited.done and to_next.done)")
    settled = table_.where("to_edited.done and to_next.done")
    sides = [F.when(~F.col(f"{t}.done"), F.struct(F.lit(k).alias("pair"), F.col(other).alias("other"))) for k, (t, other) in enumerate((("to_edited", "edited"), ("to_next", "next")))]
    pairs = open_.select("row_", "own", F.explode(F.filter(F.array(*sides), lambda p: p.isNotNull())).alias("p"))
    late = _retried(pairs.select("row_", "p.pair", "own", "p.other")).groupBy(F.col("row_").alias("r_")).agg(
        *[F.max(F.when(F.col("pair") == k, F.col("near"))).alias(f"late_{k}") for k in (0, 1)]
    )
    open_ = open_.join(late, F.col("row_") == F.col("r_")).withColumns(
        {"near_edited": F.coalesce("late_0", "near_edited"), "near_next": F.coalesce("late_1", "near_next")}
    )
    settled, open_ = settled.drop("row_"), open_.select(*[c for c in settled.columns if c != "row_"])
    full = with_sketches(settled.unionByName(open_), "own", "edited").withColumns({"fingerprint": sketch_text("sketch_own"), "edited_fingerprint": sketch_text("sketch_edited")})
    out = full.select(
        F.col("id_").alias(id_col), F.col("size").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times",
    )
    return repeated(out, "times")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; see compare_with_edits for odd rows."""
    return compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))

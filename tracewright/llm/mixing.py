"""Mixing sources to target weights with Sainte-Lague quotas of equal-token blocks.

Documents are dealt to shards of a source by a seeded hash, and each shard's
words form one stream that is cut into blocks of equally many words. Targets
become whole blocks for each source by the highest quotients target / (2k + 1),
and a source's blocks become quotas of its shards in the same way. A shard
takes its whole stream as often as its quota allows and the rest as blocks in
a seeded order. Words of a document that lie in several taken blocks count
each time, so a block may take a part of a document.

Word counts are taken once; all else works on narrow rows. No step needs a
source's rows together: only shards (at most SHARD_WORDS words on average) are
ordered, and quotients are listed only where seats are in doubt, a few for each source or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import broadcast_if_small, cut, repeated, row_hash, table

WORD = r"[^ \t-\r]+"
#: Sources in order of their names weigh these, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source's target and no document's words exceed this many times its size.
EPOCHS = 3
#: Blocks in which all targets together are counted, at least; more as soon as a block would pass its part of a shard.
BLOCKS = 20_000
#: Words of a shard, about; what one task orders.
SHARD_WORDS = 400_000
#: Blocks of a shard, at least about, however large the corpus.
SHARD_BLOCKS = 100
#: Sources whose figures are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with weight, target: shares of all words by weight, none above EPOCHS times its size.

    The excess of sources at their limit is shared again by weight. With limit
    over weight ascending, a source is at its limit exactly if the words left by
    those before it would, by weight, give it that much; so one ordered pass
    finds all. Empty sources get zero.
    """
    order = F.col("source").asc_nulls_last()
    ranked = sources.withColumn("rank_", F.row_number().over(Window.orderBy(order)) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank_") % len(WEIGHTS) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (EPOCHS * F.col("source_size")).alias("limit_"))
    by_need = Window.orderBy(F.col("limit_") / F.col("weight"), order)
    before, all_rows = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stepped = weighed.select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit_").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    stepped = stepped.withColumn("level_", F.col("words_left") / F.col("weight_left"))
    limited = F.col("limit_") <= F.col("level_") * F.col("weight")
    # past the first source below its limit the level stays as it is there
    level = F.min(F.when(~limited, F.struct(F.col("limit_") / F.col("weight"), "level_"))).over(all_rows)["level_"]
    return stepped.select("source", "source_size", "weight", F.when(limited, F.col("limit_").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def apportion(votes: DataFrame, group: list[str], key: str, value: str, seats: Column, most: Column) -> DataFrame:
    """Sainte-Lague seats for each key within its group: the `seats` highest quotients value / (2k + 1), ties by key.

    A key gets at most `most` seats. All seats of a group lie among quotients down
    to total / (2 seats + number of keys), a floor that would give out at least as
    many; those from total / (2 seats - number of keys) on number at most `seats`,
    so they are seats unseen (one fewer for each key, for rounding). Only the few
    between are listed.
    """
    within = Window.partitionBy(*group)
    sure = F.floor((F.col(value) * (2 * F.col("seats_") - F.col("keys_")) / F.col("all_votes_") + 1) / 2) - 1
    listed = (
        votes.withColumns({"seats_": seats.cast("long"), "most_": most.cast("long")})
        .withColumns({"all_votes_": F.sum(value).over(within), "keys_": F.count("*").over(within)})
        .withColumn("floor_", F.col("all_votes_") / (2 * F.col("seats_") + F.col("keys_")))
        .where((F.col(value) > 0) & (F.col("seats_") > 0) & (F.col("most_") > 0))
        .withColumn("listed_", F.least(F.col("most_"), F.floor((F.col(value) / F.col("floor_") + 1) / 2) + 1))
        .withColumn("sure_", F.greatest(F.lit(0), F.least(sure, F.col("listed_") - 1)).cast("long"))
        .withColumn("left_", F.col("seats_") - F.sum("sure_").over(within))
        .select("*", F.explode(F.sequence(F.col("sure_"), F.col("listed_") - 1)).alias("k_"))
        .withColumn("place_", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(value) / (2 * F.col("k_") + 1)).desc(), F.col(key).asc_nulls_last(), "k_")))
    )
    taken = F.max("sure_") + F.sum(F.when(F.col("place_") <= F.col("left_"), 1).otherwise(0))
    return listed.groupBy(*group, key).agg(taken.cast("long").alias("seats")).where("seats > 0")


def shares(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For sized rows (row_, doc_id, source, size): the sources' figures, and each row's place in its shard.

    Places: row_, source, shard, start (of its words in the shard's stream),
    stream (words), block (words of a block), whole (times the stream is taken
    whole), picked (number of further blocks to pick).
    """
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    total = F.sum("target").over(Window.partitionBy())
    quota = sources.withColumns({"one": F.lit(1), "block": F.greatest(F.lit(1), F.least(F.ceil(total / BLOCKS), F.lit(SHARD_WORDS // SHARD_BLOCKS))).cast("long"), "all_": total})
    seats = apportion(
        quota, ["one"], "source", "target",
        F.greatest(F.lit(1), F.round(F.col("all_") / F.col("block"))), F.ceil(EPOCHS * F.col("source_size") / F.col("block")),
    )
    quota = cut(
        quota.join(seats.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")), "left").select(
            "source", "source_size", "target", "block", F.coalesce("seats", F.lit(0)).alias("seats"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("shards"),
        )
    )
    few = broadcast_if_small(quota.withColumnRenamed("source", "s_"), BROADCAST_SOURCES)
    dealt = sized.join(few, F.col("source").eqNullSafe(F.col("s_"))).select(
        "row_", "doc_id", "source", "size", "block", "seats", "source_size",
        F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.col("shards")).alias("shard"),
    )
    streams = dealt.groupBy("source", "shard", "block", "seats", "source_size").agg(F.sum("size").alias("stream"))
    shard_seats = apportion(streams, ["source"], "shard", "stream", F.col("seats"), F.ceil(EPOCHS * F.col("stream") / F.col("block")))
    joined = streams.join(
        shard_seats.select(F.col("source").alias("s_"), F.col("shard").alias("h_"), F.col("seats").alias("taken_blocks")),
        F.col("source").eqNullSafe(F.col("s_")) & (F.col("shard") == F.col("h_")), "left",
    )
    words = F.least(EPOCHS * F.col("stream"), F.coalesce("taken_blocks", F.lit(0)) * F.col("block"))
    plan = cut(
        joined.select(
            F.col("source").alias("s_"), F.col("shard").alias("h_"), "stream",
            F.when(F.col("stream") > 0, F.floor(words / F.col("stream"))).otherwise(0).alias("whole"),
            F.when(F.col("stream") > 0, F.round((words % F.col("stream")) / F.col("block"))).otherwise(0).alias("picked"),
        )
    )
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id", "size", "row_")
    placed = dealt.select(
        "row_", "doc_id", "source", "shard", "size", "block",
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    return quota, placed.join(plan, F.col("source").eqNullSafe(F.col("s_")) & (F.col("shard") == F.col("h_"))).drop("s_", "h_")


def taken_pieces(placed: DataFrame) -> DataFrame:
    """Rows of placed with whole, and from_, to_: runs of the document's words in picked blocks (at most one run each block)."""
    blocks = placed.select("source", "shard", "stream", "block", "picked").where("picked > 0").distinct()
    ordered = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(SEED + 2), "source", "shard", "number"), "number")
    chosen = (
        blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("stream") / F.col("block")) - 1).cast("long"))).alias("number"))
        .withColumn("turn", F.row_number().over(ordered))
        .where("turn <= picked")
        .select(F.col("source").alias("s_"), F.col("shard").alias("h_"), F.col("number").alias("n_"))
    )
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    crossing = placed.where("size > 0 and picked > 0").select("*", F.explode(F.sequence(first, last)).alias("number"))
    return crossing.join(
        chosen, F.col("source").eqNullSafe(F.col("s_")) & (F.col("shard") == F.col("h_")) & (F.col("number") == F.col("n_"))
    ).select(
        "row_",
        F.greatest(F.lit(0), F.col("number") * F.col("block") - F.col("start")).alias("from_"),
        F.least(F.col("size"), (F.col("number") + 1) * F.col("block") - F.col("start")).alias("to_"),
    )


def _joined(runs: Column) -> Column:
    """Sorted runs with those that touch made one."""

    def step(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["from_"].alias("from_"), run["to_"].alias("to_"))))
        return F.when(F.size(done) == 0, F.array(run)).when(F.get(done, F.size(done) - 1)["to_"] == run["from_"], longer).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast("array<struct<from_:bigint,to_:bigint>>"), step)


def mix(sized: DataFrame) -> DataFrame:
    """sized rows (row_, doc_id, source, size) with source_size, target, taken, and pieces: ARRAY<STRUCT<from_, to_>> beside whole copies.

    taken = whole * size + the pieces' lengths, never above EPOCHS * size. Empty
    documents take nothing. Null sources are one source, the last. Null ids and
    repeated rows are rows like others. No rows give no rows.
    """
    quota, placed = shares(sized)
    placed = cut(placed)
    pieces = (
        taken_pieces(placed).groupBy(F.col("row_").alias("r_"))
        .agg(F.sum(F.col("to_") - F.col("from_")).alias("more_"), _joined(F.sort_array(F.collect_list(F.struct("from_", "to_")))).alias("pieces"))
    )
    few = broadcast_if_small(quota.select(F.col("source").alias("s_"), "source_size", "target"), BROADCAST_SOURCES)
    return (
        placed.join(pieces, F.col("row_") == F.col("r_"), "left")
        .join(few, F.col("source").eqNullSafe(F.col("s_")))
        .select(
            "row_", "doc_id", "source", "size", "source_size", "target", "whole",
            (F.col("whole") * F.col("size") + F.coalesce("more_", F.lit(0))).cast("long").alias("taken"),
            F.when(F.col("pieces").isNotNull(), F.col("pieces")).otherwise(F.array().cast("array<struct<from_:bigint,to_:bigint>>")).alias("pieces"),
        )
    )


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones included; see mix for odd rows. Very long texts count with all their words. Other columns aren't read."""
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select(F.monotonically_increasing_id().alias("row_"), "doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix as documents. Whole copies keep their text; each run of a document's words in a picked block is a row of its own.

    A run keeps the white space between its words. n_chars follows the text of
    each row; all other columns stay, whatever their names. Null and empty texts
    have no words and take nothing. Repeated rows are mixed like others. No rows
    give no rows. docs is read twice: for the words' numbers, and for the texts,
    which meet their runs by the hash of their rows.
    """
    columns = docs.columns
    hashed = docs.select(row_hash(docs).alias("hash_"), F.struct(*columns).alias("doc_"))
    numbered = hashed.select(F.monotonically_increasing_id().alias("row_"), "hash_", "doc_.doc_id", "doc_.source", n_words(F.col("doc_.text")).alias("size"))
    sized = cut(numbered)
    mixed = mix(sized.select("row_", "doc_id", "source", "size")).where("taken > 0").select(F.col("row_").alias("r_"), "whole", "pieces")
    mixed = cut(mixed.join(sized.select("row_", "hash_", "size"), F.col("r_") == F.col("row_")).select("hash_", "size", "whole", "pieces"))
    copies = mixed.where("whole > 0").groupBy("hash_").agg(F.sum("whole").alias("times_")).select("hash_", "times_", F.lit(None).cast("struct<from_:bigint,to_:bigint>").alias("run_"))
    parts = mixed.select("hash_", F.lit(1).cast("long").alias("times_"), F.explode("pieces").alias("run_"))
    runs = copies.unionByName(parts).withColumnRenamed("hash_", "h_")
    twice = not sized.groupBy("hash_").count().where("count > 1").isEmpty()
    texts = (hashed.dropDuplicates(["hash_"]) if twice else hashed).join(runs, F.col("hash_") == F.col("h_"))
    words = F.regexp_extract_all("doc_.text", F.lit(rf"({WORD}[ \t-\r]*)"))
    part = F.array_join(F.slice(words, (F.col("run_.from_") + 1).cast("int"), (F.col("run_.to_") - F.col("run_.from_")).cast("int")), "")
    part = F.regexp_replace(part, r"[ \t-\r]+$", "")
    out = texts.select("doc_", "times_", F.when(F.col("run_").isNull(), F.col("doc_.text")).otherwise(part).alias("part_"))
    changed = {"text": F.col("part_"), "n_chars": F.length("part_").cast("long")}
    return repeated(out, "times_").select(*[changed[c].alias(c) if c in changed else F.col("doc_")[c].alias(c) for c in columns])

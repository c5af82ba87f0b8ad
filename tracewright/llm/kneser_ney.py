"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is of characters, order ORDER, from trusted texts. Its counts and
continuation counts live in tables sharded by n-gram; joining the n-grams of
the corpus with them gives each n-gram's probability once. The most frequent
n-grams' log probabilities (HEAD, a fixed number) are broadcast, and the other
n-grams of each document are joined by a shuffle, so frequent n-grams never meet
in one task. A document is kept up to a quantile of the perplexities that its
language's trusted, held-out texts have.

An n-gram is one BIGINT of 16 bits for each character; characters beyond U+FFFF
share one symbol. Three marks stand before a text and one ends it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import broadcast_if_small, cut, most_frequent, small_batches, table

ORDER = 4
START, STOP, BEYOND = 0xFFFE, 0xFFFD, 0xFFFF
#: N-grams whose log probability is broadcast (16 bytes each).
HEAD = 1 << 18
#: Trusted rows that are broadcast to the scan of texts; more are joined by a shuffle.
BROADCAST_TRUSTED = 1_000_000
#: Of trusted texts, one in so many (by crc32 of the id) sets the thresholds and is not learned from.
HELD = 5
#: Quantile of the held-out perplexities, tolerance as a factor, and held-out texts that a language needs to use its own.
QUANTILE, SLACK, LANGUAGE_MIN = 0.99, 1.15, 50
#: Characters a task gathers before it passes on counts.
GATHER = 4_000_000


def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys of all texts in a row, number of keys of each text)."""
    parts, sizes = [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.empty(len(points) + ORDER, np.uint64)
        symbols[: ORDER - 1], symbols[-1] = START, STOP
        symbols[ORDER - 1 : -1] = np.minimum(points, BEYOND)
        keys = symbols[: len(symbols) - ORDER + 1].copy()
        for j in range(1, ORDER):
            keys <<= np.uint64(16)
            keys |= symbols[j : len(symbols) - ORDER + 1 + j]
        parts.append(keys)
        sizes[k] = len(keys)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)).view(np.int64), sizes


def _count(batches):
    def counts():
        codes, distinct = pd.factorize(np.concatenate(keys))
        learned = np.bincount(codes, np.concatenate(weights), len(distinct)).astype(np.int64)
        columns = [pa.array(distinct), pa.array(np.bincount(codes, minlength=len(distinct))), pa.array(learned)]
        return pa.RecordBatch.from_arrays(columns, ["gram", "seen", "c"])

    keys, weights, size = [], [], 0
    for batch in batches:
        found, sizes = keys_of(batch.column("text").to_pylist())
        keys.append(found)
        weights.append(np.repeat(batch.column("learn").to_numpy(zero_copy_only=False).astype(np.float64), sizes))
        size += len(found)
        if size >= GATHER:
            yield counts()
            keys, weights, size = [], [], 0
    if size:
        yield counts()


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; 0.5 where those are too few to tell (then for all three)."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first())
    if not min(n1, n2, n3, n4):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _discounted(d: list[float]) -> Column:
    return F.col("c") - F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, seen, p) for grams (gram, seen, c): p of the last character after the others, from the learned counts c.

    Below the top order a gram counts once for each different character before
    it; each order's discounts come from its own counts of counts. What an
    order leaves goes to the next, and in the end evenly to all 65,536 symbols.
    """
    placed = grams.select("gram", "seen").withColumn("p", F.lit(1.0 / (1 << 16)))
    levels, counts = [], grams.where("c > 0").select("gram", "c")
    for order in range(ORDER, 0, -1):
        levels.append((order, counts))
        if order > 1:
            shorter = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
            counts = cut(counts.groupBy(shorter.alias("gram")).agg(F.count("*").alias("c")))
    for order, counts in reversed(levels):
        d = _discounts(counts)
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("bigint")
        mass = sum((d[k] * F.sum((F.col("c") == k + 1 if k < 2 else F.col("c") >= 3).cast("long")) for k in range(3)), F.lit(0.0))
        left = counts.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), mass.alias("mass"))
        alpha = counts.select(F.col("gram").alias("g_"), _discounted(d).alias("a"))
        mask = -1 if order == 4 else (1 << 16 * order) - 1
        mine = F.col("gram").bitwiseAND(F.lit(mask).cast("bigint"))
        before = F.shiftrightunsigned(mine, 16) if order > 1 else F.lit(0).cast("bigint")
        if order == 1:  # at most 65,536 rows
            alpha, left = F.broadcast(alpha), F.broadcast(left)
        placed = (
            placed.join(alpha, mine == F.col("g_"), "left")
            .join(left, before == F.col("context"), "left")
            .withColumn("p", F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("a", F.lit(0.0)) + F.col("mass") * F.col("p")) / F.col("total")))
            .select("gram", "seen", "p")
        )
    return placed


_heads: dict[str, pd.Series] = {}


def _score(batches, head):
    key, grams, logs = head.value
    if key not in _heads:
        _heads.clear()
        _heads[key] = pd.Index(grams)
    index, logs = _heads[key], np.append(logs, 0.0)
    names = ["row_", "gram", "n", "log_p", "id_", "lang_", "held_"]
    for batch in batches:
        rows = batch.column("row_").to_numpy()
        keys, sizes = keys_of(batch.column("text").to_pylist())
        codes, distinct = pd.factorize(keys)
        place = index.get_indexer(distinct) if len(index) else np.full(len(distinct), -1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        found = np.bincount(doc, logs[place][codes], len(sizes))
        carried = [batch.column(c) for c in names[4:]]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.array(sizes), pa.array(found), *carried], names)
        rare = np.flatnonzero(place[codes] < 0)
        pairs, n = np.unique(doc[rare] * np.int64(len(distinct)) + codes[rare], return_counts=True)
        at, gram = pairs // max(1, len(distinct)), distinct[pairs % max(1, len(distinct))]
        columns = [pa.array(rows[at]), pa.array(gram, pa.int64()), pa.array(n), pa.array(np.zeros(len(at)))]
        yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(at), c.type) for c in carried], names)


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, perplexity, held) for every row; held: trusted and not learned from.

    trusted has the ids of trusted rows (repeats and nulls are ignored).
    Perplexity is by character, the end mark included; a null or empty text has
    just the end. With no trusted text every symbol has probability 2^-16.
    """
    spark = docs.sparkSession
    small_batches(spark)
    trusted = trusted.select(F.col(id_col).alias("t_")).where("t_ is not null").distinct()
    marked = docs.select(F.col(id_col).alias("id_"), F.col(lang_col).alias("lang_"), F.col(text_col).alias("text"))
    marked = marked.join(broadcast_if_small(trusted, BROADCAST_TRUSTED), F.col("id_") == F.col("t_"), "left")
    aside = F.pmod(F.crc32(F.col("id_").cast("string").cast("binary")), F.lit(HELD)) == 0
    known = F.col("t_").isNotNull()
    marked = marked.select("id_", "lang_", "text", (known & ~aside).alias("learn"), (known & aside).alias("held_"))
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("learn", "held_")})

    counted = marked.select("text", "learn").mapInArrow(_count, "gram long, seen long, c long")
    grams = cut(counted.groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("c").alias("c")))
    logs = cut(probabilities(grams).select("gram", "seen", F.log10("p").alias("log_p")))
    top = most_frequent(logs, "seen", HEAD).toPandas()  # at most HEAD rows
    head = spark.sparkContext.broadcast((uuid.uuid4().hex, top["gram"].to_numpy(np.int64), top["log_p"].to_numpy(np.float64)))

    kinds = {c: marked.schema[c].dataType.simpleString() for c in ("id_", "lang_")}
    schema = f"row_ long, gram long, n long, log_p double, id_ {kinds['id_']}, lang_ {kinds['lang_']}, held_ boolean"
    numbered = marked.select(F.monotonically_increasing_id().alias("row_"), "text", "id_", "lang_", "held_")
    scored = numbered.mapInArrow(lambda batches: _score(batches, head), schema)
    whole, rare = F.col("gram").isNull(), logs.select(F.col("gram").alias("g_"), F.col("log_p").alias("l_"))
    key = F.coalesce("gram", F.xxhash64("row_"))  # rows of whole documents spread out and meet nothing
    joined = scored.withColumn("key", key).join(rare, (F.col("key") == F.col("g_")), "left")
    sums = joined.groupBy("row_").agg(
        F.max("id_").alias(id_col), F.max("lang_").alias(lang_col), F.max("held_").alias("held"),
        F.sum(F.when(whole, F.col("n"))).alias("n_symbols"), F.sum(F.when(whole, F.col("log_p")).otherwise(F.col("n") * F.col("l_"))).alias("log_p"),
    )
    return sums.select(id_col, lang_col, "n_symbols", F.pow(F.lit(10.0), -F.col("log_p") / F.col("n_symbols")).alias("perplexity"), "held")


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """perplexities() with threshold and kept (perplexity up to the language's threshold).

    Languages with fewer than LANGUAGE_MIN held-out texts, null among them, use
    the threshold over all; without any held-out text everything is kept.
    """
    found = cut(perplexities(docs, trusted, id_col, text_col, lang_col))
    held = found.where("held")
    quantile = F.percentile_approx("perplexity", QUANTILE, 10_000) * SLACK
    overall = held.agg(quantile.alias("o_"))
    by_lang = held.groupBy(F.col(lang_col).alias("l_")).agg(quantile.alias("q_"), F.count("*").alias("n_")).where(F.col("n_") >= LANGUAGE_MIN)
    by_lang = broadcast_if_small(cut(by_lang), 100_000)
    out = found.join(F.broadcast(overall)).join(by_lang, found[lang_col] == by_lang.l_, "left")
    out = out.withColumn("threshold", F.coalesce("q_", "o_"))
    return out.select(id_col, lang_col, "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones included. Null and empty texts are scored by their end alone; very long texts are read whole; no rows give no rows."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)

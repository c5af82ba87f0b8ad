"""Quality rules whose cut-offs adapt to each language and source.

Every rule is a ratio of a document. A mergeable sketch (counts in
logarithmic buckets, so adding counts merges sketches exactly and a quantile is
right within GROWTH) is kept for each language and source. A group's quantiles
are those of its own sketch with the sketch of its language added at a weight of
WEIGHT documents, and that one's with the sketch of all documents, so that small
groups lean on larger ones by degrees. A cut-off lies FENCE widths of the middle
half outside it, and UNITS of the smallest step that a document of the group's
median size can take (one symbol of so many characters, one line of so many),
so no cut-off is a fixed number. Where the middle half has no width, as with
rules that most documents of a group meet with the same value, the group's UPPER quantile cuts
off if it lies lower. Everything is DataFrame functions; the join
with the cut-offs filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import broadcast_if_small, cut, table

SPACE = r"[ \t-\r]"
NOT_SPACE = r"[^ \t-\r]"
SYMBOLS = "#*$%&|<>"

#: Widths of the sketches' buckets; a quantile is off by this factor at most.
GROWTH = 1.05
LEAST = 1e-4
#: Documents that a larger group's sketch counts for in a smaller one's.
WEIGHT = 200.0
#: Share of a group's documents up to whose measure a rule lets pass where the middle half has no width, as most are then zero or alike.
UPPER = 0.95
#: Distance of a cut-off from the middle half, in widths of that half.
FENCE = 6.0
#: Further distance, in steps of a document of median size.
UNITS = 4.0
#: Each rule's denominator, and how much of it one step is: a repeated window has eight words.
RULES = {"symbol_ratio": ("word_chars", 1), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", 8), "upper_ratio": ("word_chars", 1), "word_length": ("n_words", 1)}
#: Rules that a small value can fail too: means, whose step is one more word of median length.
TWO_SIDED = {"word_length"}
#: Groups whose cut-offs are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIZES = ["n_words", "word_chars", "n_lines"]


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts (BASE), n_lines, base_failed and one column for each rule.

    A null text counts as empty: no words, all ratios 0. Texts are measured
    whole, however long. Repeated rows stay, no rows give no rows. Columns of
    docs with the measures' names are replaced, all others kept.
    """
    own = [c for c in docs.columns if c not in {*BASE, "n_lines", "base_failed", *RULES}]
    kept, text = ["row_"], F.coalesce(F.col("text_"), F.lit(""))
    step = docs.select(F.struct(*own).alias("row_"), F.col(text_col).alias("text_")).select(
        *kept,
        F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("words_"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines_"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("upper_"),
    )
    step = step.select(
        *kept, "word_chars", "n_symbols", "upper_",
        F.size("words_").cast("long").alias("n_words"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.transform("words_", lambda w: F.xxhash64(w)).alias("hashes_"),
    )
    carried = [*kept, "word_chars", "n_symbols", "upper_", "n_words", "n_lines", "n_dup_lines"]
    windows = F.when(
        F.size("hashes_") >= 8,
        F.transform(
            F.slice("hashes_", 1, F.size("hashes_") - 7),
            lambda h, i: F.xxhash64(h, *[F.get("hashes_", i + k) for k in range(1, 8)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*carried, windows.alias("windows_"))
    step = step.select(
        *carried,
        F.when(
            F.size(F.array_distinct("windows_")) < F.size("windows_"),
            F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted_"),
    )
    step = step.select(
        *carried,
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted_",
                    lambda s, k: F.coalesce(F.get("sorted_", k - 1)["h"] == s["h"], F.lit(False))
                    | F.coalesce(F.get("sorted_", k + 1)["h"] == s["h"], F.lit(False)),
                ),
                lambda s: s["i"],
            )
        ).alias("at_"),
    )
    covered = F.aggregate(
        F.transform("at_", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("at_", k + 1) - p, F.lit(8)))),
        F.lit(0), lambda total, x: total + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return step.select(
        "row_.*", *BASE, "n_lines",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("upper_", "word_chars").alias("upper_ratio"),
        ratio("word_chars", "n_words").alias("word_length"),
    )


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches by keys and measure as rows (keys, measure, bucket, n); equal keys add up, so parts merge by a sum."""
    pairs = F.array(*[F.struct(F.lit(r).alias("measure"), F.col(r).cast("double").alias("x")) for r in [*RULES, *SIZES]])
    bucket = F.when(F.col("m.x") <= LEAST, 0).otherwise(F.ceil(F.log(F.col("m.x") / LEAST) / F.log(F.lit(GROWTH)))).cast("int")
    return (
        measured.select(*keys, F.explode(pairs).alias("m"))
        .groupBy(*keys, F.col("m.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _shrunk(parts: DataFrame, keys: list[str], above: DataFrame, above_keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, share) of a group's sketch with that of the group above it, whose shares count for WEIGHT documents."""
    own = parts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    totals = own.groupBy(*keys, "measure").agg(F.sum("n").alias("total"))
    frame = totals.alias("t").join(above.alias("a"), _same("t", "a", [*above_keys, "measure"])).select(*[F.col(f"t.{k}").alias(k) for k in keys], "t.measure", "a.bucket", "total", F.col("share").alias("above"))
    return (
        frame.alias("f").join(own.alias("o"), _same("f", "o", [*keys, "measure", "bucket"]), "left")
        .select(*[F.col(f"f.{k}").alias(k) for k in keys], "f.measure", "f.bucket", ((F.coalesce("n", F.lit(0)) + WEIGHT * F.col("above")) / (F.col("total") + WEIGHT)).alias("share"))
    )


def _quantiles(shares: DataFrame, keys: list[str]) -> DataFrame:
    """q25, q50, q75 and the UPPER quantile (high) by keys and measure: the middles of the first buckets up to which so large a share lies."""
    upto = F.sum("share").over(Window.partitionBy(*keys, "measure").orderBy("bucket"))
    middle = F.when(F.col("bucket") == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GROWTH), F.col("bucket") - 0.5))
    ranked = shares.select(*keys, "measure", upto.alias("upto"), middle.alias("x"))
    return ranked.groupBy(*keys, "measure").agg(*[F.min(F.when(F.col("upto") >= q, F.col("x"))).alias(name) for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("high", UPPER))])


def cutoffs(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang_, source_, cuts) for each pair of language and source in measured, nulls being groups of their own; cuts has struct<low, high> by rule."""
    groups = ["lang_", "source_"]
    parts = cut(sketches(measured.select(F.col(lang).alias("lang_"), F.col(source).alias("source_"), *RULES, *SIZES), groups))
    merged = parts.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    total = merged.groupBy(F.col("measure").alias("m_")).agg(F.sum("n").alias("total"))
    overall = merged.join(total, F.col("measure") == F.col("m_")).select("measure", "bucket", (F.col("n") / F.col("total")).alias("share"))
    by_lang = cut(_shrunk(parts, ["lang_"], overall, []))
    own = _quantiles(_shrunk(parts, groups, by_lang, ["lang_"]), groups)
    quantile = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))

    def fence(rule: str) -> Column:
        size, step = RULES[rule]
        q25, q75 = quantile(rule, "q25"), quantile(rule, "q75")
        steps = step * quantile(rule, "q50") if rule in TWO_SIDED else F.lit(float(step))
        beyond = FENCE * (q75 - q25) + UNITS * steps / F.greatest(F.lit(1.0), quantile(size, "q50"))
        # a quantile stands for its whole bucket
        fence_ = q75 * GROWTH + beyond
        high = fence_ if rule in TWO_SIDED else F.when(q25 == q75, F.least(fence_, quantile(rule, "high") * GROWTH)).otherwise(fence_)
        return F.struct((q25 / GROWTH - beyond).alias("low"), high.alias("high")).alias(rule)

    return cut(own.groupBy(*groups).agg(*[fence(r) for r in RULES]).select(*groups, F.struct(*RULES).alias("cuts")))


def judged(rows: DataFrame, lang: str = "lang", source: str = "source", measured: DataFrame | None = None) -> DataFrame:
    """rows (with their measures) with kept: neither base_failed nor any rule outside its group's cut-offs.

    The cut-offs come from measured, or else from rows, read once more. A column
    named kept is replaced, all others are kept.
    """
    cuts = broadcast_if_small(cutoffs(measured or rows, lang, source), BROADCAST_GROUPS)
    value = lambda r: F.col(f"row_.{r}")
    inside = reduce(
        lambda a, b: a & b,
        [value(r).between(F.col(f"cuts.{r}.low"), F.col(f"cuts.{r}.high")) if r in TWO_SIDED else value(r) <= F.col(f"cuts.{r}.high") for r in RULES],
    )
    packed = rows.select(F.struct(*[c for c in rows.columns if c != "kept"]).alias("row_"))
    joined = packed.join(cuts, value(lang).eqNullSafe(F.col("lang_")) & value(source).eqNullSafe(F.col("source_")))
    return joined.select("row_.*", (~value("base_failed") & inside).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; see with_measures and judged for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = cut(with_measures(docs).drop("text"))
    return judged(measured).select("doc_id", *BASE, "base_failed", "kept")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with the columns they came with, whatever their names.

    Null and empty texts go (fewer than 20 words). Repeated rows stay or go
    together. No rows give no rows. docs is read twice, so texts are neither kept
    nor moved; the row number keeps the optimizer from copying the measures'
    expressions into the filter.
    """
    measured = with_measures(docs.select(F.struct(*docs.columns).alias("doc_"), "text", "lang", "source"))
    numbered = measured.withColumn("number_", F.monotonically_increasing_id())
    return judged(numbered, measured=measured).where("kept and number_ >= 0").select("doc_.*")


#: DuckDB's form of op6_quality_rules.
ORACLE = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)
), win AS (
  SELECT r, i, hash(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS h,
    count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS size FROM w
), twice AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, h) AS seen FROM win WHERE size = 8
), covered AS (
  SELECT r, sum(least(8, coalesce(lead_i - i, 8))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM twice WHERE seen > 1) GROUP BY r
), n AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r
), l AS (
  SELECT r, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
), m AS MATERIALIZED (
  SELECT r, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length
  FROM (
    SELECT d.r, doc_id, lang, source, coalesce(n.n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
      n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines
    FROM d JOIN l USING (r) LEFT JOIN n USING (r) LEFT JOIN covered USING (r)
  )
), p AS MATERIALIZED (
  SELECT lang, source, measure, CASE WHEN x <= {LEAST} THEN 0 ELSE ceil(ln(x / {LEAST}) / ln({GROWTH}))::INT END AS bucket, count(*) AS n
  FROM (
    {" UNION ALL ".join(f"SELECT lang, source, '{c}' AS measure, {c}::DOUBLE AS x FROM m" for c in [*RULES, *SIZES])}
  ) GROUP BY ALL
), overall AS (
  SELECT measure, bucket, sum(n) / sum(sum(n)) OVER (PARTITION BY measure) AS share FROM p GROUP BY measure, bucket
), by_lang AS (
  SELECT t.lang, t.measure, a.bucket, (coalesce(o.n, 0) + {WEIGHT} * a.share) / (t.total + {WEIGHT}) AS share
  FROM (SELECT lang, measure, sum(n) AS total FROM p GROUP BY ALL) t JOIN overall a USING (measure)
  LEFT JOIN (SELECT lang, measure, bucket, sum(n) AS n FROM p GROUP BY ALL) o
    ON o.lang IS NOT DISTINCT FROM t.lang AND o.measure = t.measure AND o.bucket = a.bucket
), own AS (
  SELECT t.lang, t.source, t.measure, a.bucket, (coalesce(o.n, 0) + {WEIGHT} * a.share) / (t.total + {WEIGHT}) AS share
  FROM (SELECT lang, source, measure, sum(n) AS total FROM p GROUP BY ALL) t JOIN by_lang a ON a.lang IS NOT DISTINCT FROM t.lang AND a.measure = t.measure
  LEFT JOIN p o ON o.lang IS NOT DISTINCT FROM t.lang AND o.source IS NOT DISTINCT FROM t.source AND o.measure = t.measure AND o.bucket = a.bucket
), q AS (
  SELECT lang, source, measure, min(x) FILTER (upto >= 0.25) AS q25, min(x) FILTER (upto >= 0.5) AS q50, min(x) FILTER (upto >= 0.75) AS q75, min(x) FILTER (upto >= {UPPER}) AS high
  FROM (
    SELECT lang, source, measure, sum(share) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto,
      CASE WHEN bucket = 0 THEN 0 ELSE {LEAST} * pow({GROWTH}, bucket - 0.5) END AS x FROM own
  ) GROUP BY ALL
), s AS (
  SELECT lang, source, {", ".join(f"max(q50) FILTER (measure = '{c}') AS {c}_50" for c in SIZES)} FROM q GROUP BY ALL
), failing AS (
  SELECT DISTINCT x.r FROM (
    {" UNION ALL ".join(f"SELECT r, lang, source, '{c}' AS measure, {c} AS x, {'true' if c in TWO_SIDED else 'false'} AS two_sided FROM m" for c in RULES)}
  ) x JOIN (
    SELECT q.*, {FENCE} * (q75 - q25) + {UNITS} * CASE q.measure {" ".join(f"WHEN '{c}' THEN {f'{step} * q50' if c in TWO_SIDED else float(step)} / greatest(1.0, {size}_50)" for c, (size, step) in RULES.items())} END AS beyond
    FROM q JOIN s ON s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source
  ) c ON c.lang IS NOT DISTINCT FROM x.lang AND c.source IS NOT DISTINCT FROM x.source AND c.measure = x.measure
  WHERE x.x > CASE WHEN q25 = q75 AND NOT two_sided THEN least(q75 * {GROWTH} + beyond, high * {GROWTH}) ELSE q75 * {GROWTH} + beyond END OR two_sided AND x.x < q25 / {GROWTH} - beyond
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM failing) AS kept FROM m
"""

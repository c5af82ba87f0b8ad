"""Secret scans: candidate strings judged by a random forest.

Candidates are runs of key characters with a digit, found in each word of a
text. Features of the string (length, character transitions, dictionary
coverage), of the word around it (path and key marks) and of its neighbouring
words go to a random forest trained from labelled findings, which removes false
positives. Everything is DataFrame functions and Spark ML's JVM transformers.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import broadcast_if_small, cut, lower_ascii, row_hash, table

SPACE = r"[ \t-\r]+"
#: A candidate: at least LEAST key characters in a row, whatever stands around them; a dotted token gives one for each part.
LEAST = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])([A-Za-z0-9+/_\-]{12,}={0,2})"
#: Words that name secrets, words that name other codes, and common pieces of prose.
KEY_WORDS = "password passwd pwd secret token apikey api_key access_key credential auth bearer private aws key"
OTHER_WORDS = "example sample dummy placeholder changeme sha1 sha256 md5 checksum digest commit hash uuid guid card account order invoice phone tel page http https www"
PROSE = "the and ing ion tion ment ent ver est ere for ers ter ted ate con pro com all ght ness able ible ous ive ist chen heit lich ung sch eur que aux ado mente cion test demo user name data file"
#: Labelled findings made by rule for the default forest (half of them secrets), and the most that train() takes.
DEFAULT_FINDINGS, MOST_FINDINGS = 6_000, 200_000
TREES, DEPTH, SEED, CUT = 24, 7, 11, 0.5
#: Documents with findings that are broadcast; more are joined by a shuffle.
BROADCAST_DOCS = 20_000
FEATURES = ["length", "transitions", "coverage", "digits", "uppers", "variety", "only_hex", "only_digits", "known_prefix", "assigned", "quoted", "slashes", "dots", "key_near", "other_near", "key_word", "other_word"]
MASK = "[SECRET]"


def candidates(text: Column) -> Column:
    """ARRAY<STRUCT<at, value, word, before, after>>: the word's number from 0, the string, the word, three words before and two after.

    A word with several strings gives one candidate for each. Null and empty
    texts give none.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

    def listed(words: Column) -> Column:
        marked = F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
            lambda s: (F.length(s["w"]) >= LEAST) & s["w"].rlike("[0-9]") & s["w"].rlike(CANDIDATE),
        )
        return F.flatten(
            F.transform(
                marked,
                lambda s: F.transform(
                    F.filter(F.regexp_extract_all(s["w"], F.lit(CANDIDATE), F.lit(1)), lambda v: v.rlike("[0-9]")),
                    lambda v: F.struct(
                        s["i"].cast("long").alias("at"), v.alias("value"), s["w"].alias("word"),
                        F.array_join(F.slice(words, F.greatest(s["i"] - 2, F.lit(1)), F.least(s["i"], F.lit(3))), " ").alias("before"),
                        F.array_join(F.slice(words, s["i"] + 2, 2), " ").alias("after"),
                    ),
                ),
            )
        )

    return F.transform(F.array(words), listed)[0]


def _any_of(text: Column, words: str) -> Column:
    return lower_ascii(text).rlike("(?:^|[^a-z0-9])(?:" + "|".join(words.split()) + ")(?:[^a-z]|$)").cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """found (value, word, before, after, ...) with one DOUBLE column for each of FEATURES."""
    v, size = F.col("value"), F.length("value").cast("double")
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    around = F.expr("replace(word, value, '')")
    return found.withColumns(
        {
            "length": size,
            "transitions": _count(v, turns) / size,
            "coverage": 1 - F.length(F.regexp_replace(lower_ascii(v), "|".join(PROSE.split()), "")) / size,
            "digits": _count(v, "[0-9]") / size,
            "uppers": _count(v, "[A-Z]") / size,
            "variety": F.size(F.array_distinct(F.split(v, ""))).cast("double") / F.least(size, F.lit(32.0)),
            "only_hex": v.rlike("^[0-9a-f]+$").cast("double"),
            "only_digits": v.rlike("^[0-9]+$").cast("double"),
            "known_prefix": v.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|AIza)").cast("double"),
            "assigned": around.rlike("[=:]").cast("double"),
            "quoted": around.rlike("[\"']").cast("double"),
            "slashes": _count(F.col("word"), "/"),
            "dots": _count(F.col("word"), r"\."),
            "key_near": _any_of(F.concat_ws(" ", "before", around), KEY_WORDS),
            "other_near": _any_of(F.concat_ws(" ", "before", around, "after"), OTHER_WORDS),
            "key_word": _any_of(v, KEY_WORDS),
            "other_word": _any_of(v, OTHER_WORDS),
        }
    )


def labelled_findings(spark: SparkSession, n: int = DEFAULT_FINDINGS) -> DataFrame:
    """Findings (value, word, before, after, label) made by rule from hashes of row numbers; even rows are secrets."""
    hexes, mixed = F.sha2(F.concat(F.lit("h"), "id"), 512), F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 512))), "[+/=]", "x7")
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    one_of = lambda words, salt: F.element_at(F.array(*map(F.lit, words.split())), (pick(len(words.split()), salt) + 1).cast("int"))
    part = lambda s, low, high, salt: F.substr(s, F.lit(1), (pick(high - low + 1, salt) + low).cast("int"))
    prose = F.concat_ws("", *[one_of(PROSE, f"p{k}") for k in range(5)])
    plain = F.concat_ws(" ", one_of(PROSE, "q1"), one_of(PROSE, "q2"), prose)
    key = one_of("password passwd secret token api_key access_key", "k")
    digits = F.lpad(F.abs(F.xxhash64("id", F.lit("d"))).cast("string"), 19, "4")
    base = F.col("base")
    kinds = [  # (label, value, word around it, words before)
        (1, part(hexes, 16, 64, "1"), F.concat(key, F.lit("="), base), plain),
        (1, part(mixed, 16, 60, "2"), F.concat(key, F.lit(":"), base), plain),
        (1, part(hexes, 24, 64, "3"), F.concat(F.lit('"'), base, F.lit('"')), F.concat(plain, F.lit(" "), key, F.lit(" ="))),
        (1, part(mixed, 20, 60, "4"), F.concat(F.lit("'"), base, F.lit("',")), F.concat(plain, F.lit(" "), key, F.lit(":"))),
        (1, F.concat(one_of("AKIA ASIA", "a"), F.substr(F.upper(F.regexp_replace(mixed, "[a-z]", "")), F.lit(1), F.lit(16))), base, plain),
        (1, F.concat(one_of("ghp_ sk_live_ xoxb- AIza", "g"), part(mixed, 30, 40, "5")), base, plain),
        (1, part(mixed, 20, 60, "10"), F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), base, F.lit("."), F.substr(mixed, F.lit(30), F.lit(40))), F.concat(plain, F.lit(" "), one_of("bearer token auth", "j"))),
        (0, F.substr(digits, F.lit(1), F.lit(16)), base, plain),
        (0, F.substr(digits, F.lit(1), F.lit(16)), F.concat(base, one_of("$$$ ### , . %%%", "z")), F.concat(plain, F.lit(" "), key, F.lit(' = "'), part(hexes, 32, 64, "11"), F.lit('"'))),
        (0, part(digits, 12, 19, "6"), base, F.concat(plain, F.lit(" "), one_of(OTHER_WORDS, "o"))),
        (0, F.concat(prose, F.substr(digits, F.lit(1), F.lit(2))), base, plain),
        (0, part(hexes, 32, 64, "7"), base, F.concat(plain, F.lit(" "), one_of("commit sha1 sha256 md5 checksum digest", "c"))),
        (0, F.concat_ws("/", F.lit("/usr"), one_of(PROSE, "u"), one_of(PROSE, "v"), part(digits, 3, 9, "8")), base, plain),
        (0, F.concat(one_of("example dummy placeholder changeme sample", "e"), F.lit("_"), one_of(KEY_WORDS, "w"), part(digits, 1, 4, "9")), F.concat(key, F.lit("="), base), plain),
        (0, F.concat_ws("-", *[F.substr(hexes, F.lit(a), F.lit(b)) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), base, F.concat(plain, F.lit(" "), one_of("id uuid guid request", "y"))),
        (0, F.concat(prose, F.lit("_"), F.substr(digits, F.lit(1), F.lit(3))), F.concat(F.lit("id="), base), plain),
        (0, F.concat(prose, F.lit("-"), F.substr(digits, F.lit(1), F.lit(2))), F.concat(one_of("www. mail. blog.", "h"), base, F.lit(".example.com")), plain),
    ]
    secrets, others = [k for k in kinds if k[0]], [k for k in kinds if not k[0]]

    def choose(field: int) -> Column:
        kind = (F.col("id") / 2).cast("long")
        of = lambda listed: F.element_at(F.array(*[k[field] for k in listed]), (F.pmod(kind, F.lit(len(listed))) + 1).cast("int"))
        return F.when(F.col("id") % 2 == 0, of(secrets)).otherwise(of(others))

    rows = spark.range(0, n, 1, 2).withColumn("base", choose(1))
    return rows.select(
        F.col("base").alias("value"), choose(2).alias("word"), choose(3).alias("before"), plain.alias("after"), (1 - F.col("id") % 2).cast("double").alias("label")
    )


def train(findings: DataFrame) -> RandomForestClassificationModel | None:
    """Forest from labelled findings (value, word, before, after, label); of more than MOST_FINDINGS rows those with the smallest hashes are taken.

    None, which takes nothing for a secret, if there are no findings.
    """
    if findings.isEmpty():
        return None
    rows = findings.orderBy(F.xxhash64("value", "word", "before", "after")).limit(MOST_FINDINGS)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(rows))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows.select("features", "label"))


def findings(docs: DataFrame, model: RandomForestClassificationModel | None, text_col: str = "text") -> DataFrame:
    """Rows of docs for each candidate the forest takes for a secret, without the text, with at, value, score.

    Null and empty texts have none; very long ones are searched whole. A string
    that occurs several times gives as many rows, and so do repeated rows. Columns
    of docs named at, value or score are left out. No rows give no rows.
    """
    kept = [c for c in docs.columns if c not in {text_col, "at", "value", "score"}]
    found = docs.select(*[F.col(c).alias(f"c_{c}") for c in kept], F.explode(candidates(F.col(text_col))).alias("f"))
    found = with_features(found.select(*[f"c_{c}" for c in kept], "f.*"))
    if model is None:
        scored = found.withColumn("score", F.lit(0.0)).limit(0)
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
        scored = scored.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= CUT)
    return scored.select(*[F.col(f"c_{c}").alias(c) for c in kept], "at", "value", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each found string, of each row of documents; see findings for odd rows. Other columns aren't read."""
    model = train(labelled_findings(spark))
    found = findings(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.select("doc_id", F.col("at").alias("word_index"), F.length("value").alias("length"), F.sha2("value", 256).alias("secret_sha256"), "score")


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents; found secrets are replaced by MASK in the text, and n_chars follows.

    Longer secrets are replaced first, so that one within another leaves nothing
    of either. Null and empty texts stay as they are, very long ones are scanned
    whole, repeated rows are masked alike, no rows give no rows. All other columns
    stay, whatever their names. docs is read twice; the documents with findings
    are few and joined back by the hash of their rows.
    """
    columns = docs.columns
    marked = docs.select(row_hash(docs).alias("hash_"), F.struct(*columns).alias("doc_"))
    found = findings(marked.select("hash_", F.col("doc_.text").alias("text")), train(labelled_findings(spark)))
    longest = F.sort_array(F.collect_set(F.struct(F.length("value").alias("size"), "value")), asc=False)
    values = cut(found.groupBy(F.col("hash_").alias("h_")).agg(longest.alias("values_")))
    joined = marked.join(broadcast_if_small(values, BROADCAST_DOCS), F.col("hash_") == F.col("h_"), "left")
    clean = F.aggregate("values_", F.col("doc_.text"), lambda text, value: F.replace(text, value["value"], F.lit(MASK)))
    masked = joined.select("doc_", F.when(F.col("values_").isNotNull(), clean).alias("clean_"))
    changed = {"text": F.col("clean_"), "n_chars": F.length("clean_").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    keep = lambda c: F.when(F.col("clean_").isNull(), F.col("doc_")[c]).otherwise(changed[c]) if c in changed else F.col("doc_")[c]
    return masked.select(*[keep(c).alias(c) for c in columns])

"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for the rest.

Features are the lengths of a URL and its parts, its depth, digit ratio,
entropy, parameter counts and marks, and statistics of its host's suffixes
among the labelled URLs that the trees are trained from. All of it is DataFrame
functions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, lower_ascii, table

#: Rules as (action, host and path); they hold for the host and its subdomains, for paths that start alike.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs made by rule for the default trees, and the most rows that train() takes.
DEFAULT_URLS, MOST_URLS = 4_000, 200_000
TREES, DEPTH, SEED, CUT = 20, 4, 5, 0.5
#: Weight of the overall rate in a suffix's rate.
PRIOR = 20.0
NUMBERS = ["url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "longest_label", "digit_ratio", "host_digits", "entropy", "parameters", "hyphens", "host_hyphens", "percents"]
SUFFIXES = {"suffix_1": 1, "suffix_2": 2, "suffix_3": 3}
FEATURES = NUMBERS + [f"{s}_rate" for s in SUFFIXES]
#: Words of unwanted hosts and of ordinary ones in the labelled URLs.
UNWANTED = "casino win cheap pills poker bonus loans viagra lottery slots bet replica crypto dating free prize deals"
ORDINARY = "news wiki docs blog shop city school river green home paper health music garden sport travel science books data code"


def with_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host and path; both empty for a null url or one without ://."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return urls.withColumns({"host": lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def matched_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits columns host and path; nulls if none does. Of equally long ones the first by name."""
    ordered = sorted(dict((r, a) for a, r in rules).items(), key=lambda x: (-len(x[0]), x[0]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, act in reversed(ordered):
        host, slash, tail = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + tail)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def with_numbers(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls (with host and path) with NUMBERS and the host's suffixes of one, two and three labels."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size = F.length(url).cast("double")
    shares = F.transform(
        F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / F.greatest(size, F.lit(1.0))
    )
    return urls.withColumns(
        {
            "url_length": size,
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "query_length": F.length(query).cast("double"),
            "depth": count(F.col("path"), "/[^/]"),
            "host_labels": F.size(labels).cast("double"),
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
            "digit_ratio": count(url, "[0-9]") / F.greatest(size, F.lit(1.0)),
            "host_digits": count(F.col("host"), "[0-9]"),
            "entropy": F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p)),
            "parameters": count(query, "[^&=]+="),
            "hyphens": count(url, "-"),
            "host_hyphens": count(F.col("host"), "-"),
            "percents": count(url, "%"),
            **{name: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".") for name, k in SUFFIXES.items()},
        }
    )


def labelled_urls(spark: SparkSession, n: int = DEFAULT_URLS) -> DataFrame:
    """URLs (url, label) made by rule from hashes of row numbers; a quarter is unwanted (label 1)."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words.split())), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words.split()))) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(100_000)).cast("string")
    ends = F.element_at(
        F.array(number, F.concat(number, F.lit("/")), F.concat(number, F.lit(".html")), F.concat(number, F.lit("?page=2&ref=x")), F.concat(number, F.lit("?utm_source=feed")), F.concat(number, F.lit("#top"))),
        (F.pmod(F.xxhash64("id", F.lit("e")), F.lit(6)) + 1).cast("int"),
    )
    letters = F.regexp_replace(F.base64(F.unhex(F.md5(F.col("id").cast("string")))), "[^a-z]", "")
    name = F.concat(pick(ORDINARY, "o"), F.substr(letters, F.lit(1), (F.pmod(F.xxhash64("id", F.lit("l")), F.lit(6))).cast("int")))
    bad = F.concat_ws("-", pick(UNWANTED, "a"), pick(UNWANTED, "b"), F.when(F.pmod(F.xxhash64("id", F.lit("c")), F.lit(3)) == 0, pick(UNWANTED, "d")))
    unwanted = F.col("id") % 4 == 0
    url = F.concat(
        pick("http:// https://", "s"), pick(". www. m. blog. .", "w"), F.when(unwanted, bad).otherwise(name), F.lit("."), pick("example.com example.net example.org", "t"),
        F.lit("/"), pick("en de fr es", "g"), F.lit("/"), ends,
    )
    return spark.range(0, n, 1, 2).select(F.regexp_replace(url, r"://\.", "://").alias("url"), unwanted.cast("double").alias("label"))


class UrlModel:
    """Trees and suffix statistics; the statistics have no more rows than the labelled URLs."""

    def __init__(self, trees, rates: dict[str, DataFrame], overall: float):
        self.trees, self.rates, self.overall = trees, rates, overall

    def with_rates(self, urls: DataFrame) -> DataFrame:
        for name, rates in self.rates.items():
            urls = urls.join(F.broadcast(rates), urls[name] == rates[f"{name}_"], "left").drop(f"{name}_")
        return urls.fillna(self.overall, [f"{s}_rate" for s in SUFFIXES])

    def score(self, urls: DataFrame) -> DataFrame:
        """urls (with host and path) with score, the probability that the url is unwanted."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(float(self.overall)))
        scored = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.with_rates(with_numbers(urls))))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def train(labelled: DataFrame) -> UrlModel:
    """Trees from labelled URLs (url, label 0 or 1); of more than MOST_URLS those with the smallest hashes are taken.

    Without labelled URLs, or with labels of one kind only, every URL scores that kind's share (0 without any).
    """
    rows = cut(with_numbers(with_parts(labelled.orderBy(F.xxhash64("url")).limit(MOST_URLS))))
    overall = rows.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    rates = {
        name: cut(rows.groupBy(F.col(name).alias(f"{name}_")).agg(((F.sum("label") + PRIOR * overall) / (F.count("*") + PRIOR)).alias(f"{name}_rate")))
        for name in SUFFIXES
    }
    model = UrlModel(None, rates, overall)
    if overall in (0.0, 1.0):
        return model
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(model.with_rates(rows)).select("features", "label").coalesce(2)
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)
    return model


def judge(urls: DataFrame, model: UrlModel, url_col: str = "url", rules=RULES) -> DataFrame:
    """All columns of urls with host, path, rule, verdict and score.

    A null or malformed url has empty host and path, fits no rule and gets the
    trees' verdict. Columns of urls with these names are replaced.
    """
    kept = [c for c in urls.columns if c not in {"host", "path", "rule", "verdict", "score"}]
    packed = with_parts(urls.select(F.col(url_col).alias("url"), F.struct(*kept).alias("row_")))
    rule, action = matched_rule(rules)
    scored = model.score(packed)
    out = scored.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(F.col("score") >= CUT, "block").otherwise("allow"))})
    return out.select("row_.*", "host", "path", "rule", "verdict", "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of pages, repeated ones included; see judge for null and malformed URLs. Very long URLs are read whole; no rows give no rows. Other columns aren't read."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")

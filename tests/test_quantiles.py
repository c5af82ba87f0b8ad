import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators.kernels import describe
from tracewright.operators.quantiles import exact_quantiles

WANTED = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.75, "e": 0.999, "f": 1.0}


@pytest.mark.parametrize("make", [lambda r: float(r.randint(-3, 3)), lambda r: r.lognormvariate(0, 4), lambda r: r.choice([0.0, 1e300, -1e300, 5e-324]), lambda r: r.choice([float("nan"), float("inf"), 1.0, 2.0]), lambda r: None])
def test_equals_percentile(spark, make):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2]), make(r)) for _ in range(500)] + [("alone", 1, 7.0), (None, None, 3.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(4)
    want = df.where("v is not null").groupBy("k", "j").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in WANTED.items()])
    plain = lambda rows: sorted(map(str, (tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r) for r in rows)))
    assert plain(exact_quantiles(df, ["k", "j"], "v", WANTED).collect()) == plain(want.collect())


def test_describe_has_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), (None, 5), ("b", None)], "k string, v long")
    got = {r.k: (r["count"], r.min, r.q25, r.q50, r.q75, r.max) for r in describe(df, ["k"], "v").collect()}
    assert got == {"a": (2, 1, 1.75, 2.5, 3.25, 4), None: (1, 5, 5.0, 5.0, 5.0, 5), "b": (0, None, None, None, None, None)}

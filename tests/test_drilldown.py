from pyspark.sql import functions as F

from tracewright.operators import callstack, drilldown as D

TEXT = """model
    layer @dup@
        mm @gemm
    head@shape@
"""


def test_template():
    nodes = D.parse_template(TEXT)
    assert [(n["id"], n["parent"], n["pattern"], n["dup"], n["shape"], n["rename"]) for n in nodes] == [
        (0, -1, "model", False, False, "model"), (1, 0, "layer", True, False, "layer"), (2, 1, "mm", False, False, "gemm"), (3, 0, "head", False, True, "head")]


def test_matches_spans_and_rates(spark):
    rows = [
        (0, 1, 2, 0, -1, 0, 100, "model", -1, 5), (0, 1, 2, 1, -1, 5, 30, "layer", -1, -1), (0, 1, 2, 2, -1, 6, 10, "mm", -1, -1), (0, 1, 2, 3, -1, 50, 10, "mm", -1, -1),
        (0, 1, 2, 4, -1, 7, 2, "launch", 9, -1), (0, 1, 3, 5, -1, 200, 40, "back", -1, -1), (0, 1, 3, 6, -1, 205, 4, "launch", 10, -1),
        (0, 1, 7, 9, 7, 20, 1000, "k", 4, -1), (0, 1, 7, 10, 7, 3000, 2000, "k", 6, -1),
    ]
    events = spark.createDataFrame(rows, "rank int, pid int, tid int, index long, stream int, ts long, dur long, name string, index_correlation long, fwdbwd_index long")
    events = events.withColumn("fwdbwd", F.when(F.col("fwdbwd_index") >= 0, 0).otherwise(-1)).cache()
    pairs = callstack.closure(callstack.starts_with_depth(events)).cache()
    nodes = D.template(spark, TEXT)
    matched = D.match(events, pairs, nodes).cache()
    assert sorted((r.id, r["index"]) for r in matched.collect()) == [(0, 0), (1, 1), (2, 2)]  # mm outside a layer is none
    spans = D.forward_backward_spans(matched, events, pairs, callstack.kernel_rollup(events, pairs)).cache()
    assert {r.id: (r.forward, r.backward) for r in spans.collect()} == {0: (1.0, 2.0), 1: (1.0, None), 2: (1.0, None)}
    report = {(r.rename, r.direction): r for r in D.model_report(spans, nodes).collect()}
    assert report["gemm", "forward"].mean_percent == 1.0 and report["model", "backward"].mean == 2.0
    ops = spark.sql("select parse_json('[[2,3],[3,4]]') input_dims, parse_json('[\"float\"]') input_type, 2 kernel_dur_sum union all select parse_json('[[2]]'), null, 1")
    got = sorted((r.flops, r.bytes) for r in D.gemm_rates(ops).collect() if r.flops is not None)
    assert got == [(48.0, 104.0)]


def test_trim_children(spark):
    rows = spark.createDataFrame([(0, 1, 1, -1, 0, 10), (0, 1, 2, 1, 2, 20), (0, 1, 3, 2, 5, 30), (0, 1, 4, -1, 50, 5)], "rank int, tid int, python_id long, python_parent_id long, ts long, dur long")
    assert [r.dur for r in D.trim_children(rows).orderBy("python_id").collect()] == [10, 8, 5, 5]

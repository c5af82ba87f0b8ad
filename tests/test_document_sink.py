import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewright.sources import chrome, document_sink, sinks


def load(path):
    with gzip.open(path, "rt") as file:
        return json.load(file)


def test_documents_are_readable_and_ordered(spark, tmp_path):
    events = spark.range(5000).select((F.col("id") % 3).cast("int").alias("rank"), (F.col("id") * 7919 % 5000).cast("double").alias("ts"), F.format_string('{"ph": "X", "ts": %d, "name": "é"}', F.col("id") * 7919 % 5000).alias("event"))
    heads = spark.createDataFrame([(0, '{"traceName": "t", "deviceProperties": [{"id": 0}]}'), (7, '{"a": 1}')], "rank int, header string")
    sinks.write_document(events.repartition(6), str(tmp_path / "d"), heads)
    docs = {k: load(tmp_path / "d" / f"rank={k}" / "trace.json.gz") for k in (0, 1, 2, 7)}
    for k in range(3):
        times = [e["ts"] for e in docs[k]["traceEvents"]]
        assert times == sorted(times) and len(times) == len([i for i in range(5000) if i % 3 == k])
    assert docs[0]["traceName"] == "t" and docs[1]["distributedInfo"] == {"rank": 1} and docs[7] == {"a": 1, "traceEvents": []}
    assert not (tmp_path / "d" / "_unnamed").exists()


def test_nothing_is_seen_of_a_failed_write(spark, tmp_path):
    events = spark.range(100).select((F.col("id") % 2).cast("int").alias("rank"), F.lit(0.0).alias("ts"), F.lit("{}").alias("event"))
    sinks.write_document(events, str(tmp_path / "d"))
    broken = events.withColumn("event", F.when(F.col("rank") == 1, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("event")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_document(broken, str(tmp_path / "d"))
    assert [len(load(tmp_path / "d" / f"rank={k}" / "trace.json.gz")["traceEvents"]) for k in (0, 1)] == [50, 50]
    sinks.write_document(events.where("rank = 1"), str(tmp_path / "d"))  # a new set of documents takes the old one's place
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if p.is_dir()) == ["rank=1"]


def test_rows_of_a_rank_in_several_places_are_refused(spark, tmp_path):
    spark.dataSource.register(document_sink.DocumentSink)
    rows = spark.range(8).select(F.lit(1).cast("long").alias("rank"), F.lit(None).cast("string").alias("header"), F.lit("{}").alias("event")).repartition(4)
    with pytest.raises(Exception, match="several places"):
        rows.write.format("trace_document").mode("append").save(str(tmp_path / "d"))


def test_copy_with_another_rank(spark, tmp_path):
    events = [{"ph": "X", "cat": "cpu_op", "name": "a\"b", "pid": 1, "tid": "t 1", "ts": 1.5, "dur": 2.0, "args": {"x": [1, {"y": None}], "Input Dims": []}}, {"ph": "s", "id": 3, "pid": "Spans", "tid": 2, "ts": 2.0}]
    doc = {"schemaVersion": 1, "distributedInfo": {"rank": 0, "backend": "nccl"}, "traceEvents": events, "traceName": "n"}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    chrome.copy_with_rank(spark, str(tmp_path / "t.json"), str(tmp_path / "out"), 5)
    got = load(tmp_path / "out" / "rank=5" / "trace.json.gz")
    assert got == doc | {"distributedInfo": {"rank": 5, "backend": "nccl"}}
    assert {r["rank"] for r in chrome.raw_events(spark, str(tmp_path / "out")).collect()} == {5}

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import silver
from tracewright.sources import args, chrome, sinks


def trace(rank, shift=0):
    x = lambda **k: {"ph": "X", "pid": 1, "tid": 2, **k}
    return {
        "schemaVersion": 1, "distributedInfo": {"backend": "nccl", "rank": rank, "world_size": 2}, "baseTimeNanoseconds": 1_000_000_000, "deviceProperties": [{"id": 0}],
        "traceEvents": [
            {"ph": "M", "name": "process_name", "pid": 1, "args": {"name": "python"}},
            x(cat="user_annotation", name="ProfilerStep#7", ts=0 + shift, dur=1000),
            x(cat="cpu_op", name="aten::mm", ts=10.5 + shift, dur=50.25, args={"External id": 5, "Input Dims": [[2, 3], [3, 4]], "Input type": ["float", "float"]}),
            x(cat="cuda_runtime", name="cudaLaunchKernel", ts=20 + shift, dur=5, args={"correlation": 15}),
            {"ph": "X", "cat": "kernel", "name": "gemm", "pid": 0, "tid": 7, "ts": 40 + shift, "dur": 9, "args": {"stream": 7, "correlation": 15}},
            {"ph": "X", "cat": "kernel", "name": "odd", "pid": "Spans", "tid": "t", "ts": 60 + shift, "dur": 9, "args": {"stream": "seven"}},
            {"ph": "s", "cat": "fwdbwd", "name": "fwdbwd", "id": 1, "pid": 1, "tid": 2, "ts": 10.5 + shift},
            x(cat="Trace", name="end", ts=999, dur=1), {"ph": "X", "name": "no cat", "ts": 1, "dur": 1, "pid": 1, "tid": 1},
        ],
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("traces")
    (path / "a.json").write_text(json.dumps(trace(0)))
    with gzip.open(path / "b.json.gz", "wt") as file:
        json.dump(trace(1, 100), file)
    (path / "c.json").write_text(json.dumps({"schemaVersion": 1, "distributedInfo": {"rank": 2}, "traceEvents": []}))
    return str(path)


def test_parse(spark, folder):
    raw = chrome.raw_events(spark, folder)
    rows = {(r["rank"], r["index"]): r for r in chrome.parse(raw).collect()}
    assert sorted(rows) == [(k, i) for k in (0, 1) for i in (1, 2, 3, 4, 5)]
    assert rows[0, 2].ts == 10.5 and rows[0, 2].external_id == 5 and rows[0, 2].stream == -1
    assert json.loads(str(rows[0, 2].input_dims.toJson())) == [[2, 3], [3, 4]]
    assert rows[1, 4].stream == 7 and rows[1, 4].correlation == 15
    assert rows[0, 5].stream == -1 and rows[0, 5].pid == -1 and rows[0, 5].pid_text == "Spans"
    rounded = {(r["rank"], r["index"]): r for r in chrome.parse(raw, args.ParserOptions(round_ns=True, skip_categories=("kernel",))).collect()}
    assert (rounded[0, 2].ts, rounded[0, 2].dur) == (11, 49) and (0, 4) not in rounded


def test_metadata_and_inference(spark, folder):
    assert {r["rank"]: r.maker for r in chrome.makers(chrome.raw_events(spark, folder)).collect()} == {0: "NVIDIA", 1: "NVIDIA"}
    assert {(r["rank"], r.baseTimeNanoseconds) for r in chrome.metadata(spark, folder).collect()} == {(0, 10**9), (1, 10**9), (2, None)}
    names = {r.raw: r.name for r in chrome.all_arguments(chrome.raw_events(spark, folder)).collect()}
    assert names["External id"] == "external_id" and "Input Dims" in names
    problems = {(r["rank"], r.problem): r.n for r in chrome.validate(chrome.raw_events(spark, folder)).collect()}
    assert problems[0, "device row without stream"] == 1 and problems[0, "no cat"] == 1
    assert chrome.flows(chrome.raw_events(spark, folder)).count() == 2


def test_silver_columns(spark, folder):
    events = silver.with_iteration(silver.with_index_correlation(chrome.parse(chrome.raw_events(spark, folder))))
    rows = {(r["rank"], r["index"]): r for r in events.collect()}
    assert rows[0, 3].index_correlation == 4 and rows[0, 4].index_correlation == 3
    assert rows[0, 4].iteration == 7 and rows[0, 2].iteration == 7 and rows[0, 5].iteration == 7
    unix = chrome.to_unix_ns(events, chrome.metadata(spark, folder)).where("index = 3 and rank = 1").first()
    assert unix.ts_unix_ns == 10**9 + 120_000


def test_known_correlations(spark):
    names = ["22", "12", "10", "10", "Event Sync (45)", "Context Sync (42)", "71", "12"]
    corr, stream = [15, 16, 22, -1, 15, 16, 30, -1], [-1] * 6 + [7, 7]
    rows = [(0, i + 1, n, c, s) for i, (n, c, s) in enumerate(zip(names, corr, stream))]
    df = spark.createDataFrame(rows, "rank int, index long, name string, correlation long, stream int")
    got = [r.index_correlation for r in silver.with_index_correlation(df).orderBy("index").collect()]
    assert got == [5, 6, 0, -1, 1, 2, 0, -1]


def test_write_and_read_again(spark, folder, tmp_path):
    events = chrome.parse(chrome.raw_events(spark, folder)).where("rank = 1")
    sinks.write_document(sinks.event_json(events, "stream", "correlation"), str(tmp_path / "doc"))
    again = chrome.parse(spark.read.schema(chrome.SCHEMA).option("multiLine", True).json(str(tmp_path / "doc" / "*" / "*.gz")).select(
        F.col("distributedInfo.rank").alias("rank"), F.posexplode("traceEvents").alias("index", "e")).select("rank", "index", "e.*"))
    key = lambda df: sorted((r.name, r.ts, r.dur, r.stream, r.correlation) for r in df.collect())
    assert key(again) == key(events)
    sinks.write_trace(sinks.event_json(events), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 5


def test_ingest_is_incremental(spark, folder, tmp_path):
    target = str(tmp_path / "bronze")
    assert chrome.ingest(spark, folder, target).count() == 10
    assert chrome.ingest(spark, folder, target).count() == 10
    assert spark.read.parquet(f"{target}/_manifest").count() == 3


def put(folder, name, rank, names):
    (folder / name).write_text(json.dumps({"distributedInfo": {"rank": rank}, "traceEvents": [{"ph": "X", "cat": "cpu_op", "name": n, "ts": 1, "dur": 1, "pid": 1, "tid": 1} for n in names]}))


def by_rank(df):
    return {r["rank"]: sorted(r.n) for r in df.groupBy("rank").agg(F.collect_list("name").alias("n")).collect()}


def test_ingest_replaces_whole_ranks(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "bronze")
    folder.mkdir()
    put(folder, "a.json", 0, ["old"])
    put(folder, "m.json", 1, ["one"])
    assert by_rank(chrome.ingest(spark, str(folder), target)) == {0: ["old"], 1: ["one"]}
    put(folder, "b.json", 0, ["b1", "b2"])
    put(folder, "c.json", 0, ["c"])  # two new files of a rank: the last wins
    put(folder, "l.json", 1, ["not last"])  # a new file before a known one doesn't
    assert by_rank(chrome.ingest(spark, str(folder), target)) == {0: ["c"], 1: ["one"]}
    put(folder, "m.json", 1, ["one", "changed"])
    assert by_rank(chrome.ingest(spark, str(folder), target)) == {0: ["c"], 1: ["changed", "one"]}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_ingest_after_a_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    folder, target = tmp_path / "in", str(tmp_path / "bronze")
    folder.mkdir()
    put(folder, "a.json", 0, ["a"])
    chrome.ingest(spark, str(folder), target)
    put(folder, "b.json", 0, ["b"])
    whole = DataFrameWriter.parquet

    def crashing(self, path, *args, **more):
        if path.endswith("_manifest"):
            raise OSError("crash")
        return whole(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", crashing)
    with pytest.raises(OSError):
        chrome.ingest(spark, str(folder), target)
    monkeypatch.undo()
    assert by_rank(chrome.ingest(spark, str(folder), target)) == {0: ["b"]}
    assert spark.read.parquet(f"{target}/_manifest").count() == 2


def test_ingest_of_a_thousand_files(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "bronze")
    folder.mkdir()
    for k in range(1000):
        put(folder, f"{k:04}.json", k % 20, [f"n{k}"])
    assert by_rank(chrome.ingest(spark, str(folder), target)) == {k: [f"n{980 + k}"] for k in range(20)}


def test_repair(spark):
    df = spark.createDataFrame([('{"a": , "b": }',)], "t string").select(chrome.repair_text(F.col("t")).alias("t"))
    assert json.loads(df.first().t) == {"a": None, "b": None}

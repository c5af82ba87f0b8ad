import gzip
import io
import json
import random
import tracemalloc

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.sources import chrome
from tracewright.sources import event_stream as E


def made(r, i):
    name = r.choice(["a", "é日本", 'x, {"ph": 1}', "[ {", 'q\\"', "\n"]) * r.randint(1, 5)
    return {"ph": "X", "name": name, "ts": i * 1.5, "args": {"l": [{"a": 1}, {"b": "}, {"}], "n": r.choice([None, 1, "x" * r.randint(0, 300)])}}


def in_ranges(data, split):
    events, metadata, awaited = [], {}, None
    for start in range(0, len(data), split):
        file = io.BytesIO(data)
        file.seek(start)
        found = E.Found()
        events += E.events_of(E.Text(file.read, start, whole=start == 0), start, start + split if start + split < len(data) else 1 << 62, found)
        if start and found.first is not None:
            assert found.first == awaited
        awaited = awaited if found.next is None else found.next
        metadata |= found.metadata
    return events, metadata


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_gives_the_same_events(seed, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 64)
    r = random.Random(seed)
    events = [made(r, i) for i in range(r.randint(0, 12))]
    head = {"schemaVersion": 1, "deviceProperties": [{"id": 0}, {"id": 1}]} if r.random() < 0.8 else {}
    tail = {"traceName": "t, {", "z": [{"q": 1}]} if r.random() < 0.5 else {}
    whole = events if seed % 10 == 0 else {**head, "traceEvents": events, **tail}
    data = json.dumps(whole, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1, 2])).encode()
    for split in (20, r.randint(30, 400), 1 << 20):
        got, metadata = in_ranges(data, split)
        assert got == events
        assert seed % 10 == 0 or metadata == {**head, **tail}


@pytest.mark.parametrize("text", ["", "7", '{"traceEvents": [{"ph": "X"}', '{"traceEvents": [{"ph": "X"} {"ph": "X"}]}', '{"traceEvents": [{"ph": }]}', '{"a" 1}'])
def test_malformed_text_is_an_error(text):
    with pytest.raises(E.Malformed):
        list(E.events_of(E.Text(io.BytesIO(text.encode()).read), 0, 1 << 62, E.Found()))


def test_memory_does_not_grow_with_the_file(monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 1 << 16)
    event = json.dumps({"ph": "X", "name": "n" * 100, "args": {"k": [1, 2, 3]}}).encode() + b",\n"

    def peak(n):
        left = [b'{"traceEvents": [', n]

        def read(size):
            if left[0]:
                out, left[0] = left[0], b""
                return out
            if not left[1]:
                left[1] = -1
                return b'{"ph": "X"}]}'
            k = min(left[1], 1 + size // len(event)) if left[1] > 0 else 0
            left[1] -= k
            return event * k

        tracemalloc.start()
        assert sum(1 for _ in E.events_of(E.Text(read), 0, 1 << 62, E.Found())) == n + 1
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    small, large = peak(5_000), peak(100_000)
    assert large < 1.2 * small < 2_000_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, r = tmp_path_factory.mktemp("stream"), random.Random(5)
    x = lambda i, **k: {"ph": "X", "cat": r.choice(["cpu_op", "kernel", "python_function"]), "name": f"n{i}", "pid": r.choice([1, "Spans", 2.5]), "tid": i % 3, "ts": i + 0.25, "dur": i % 7, **k}
    for rank in range(2):
        events = [x(i, args={"stream": i % 4, "correlation": i, "Input Dims": [[i]], "deep": {"a": [i]}}) if i % 5 else x(i) for i in range(3000)]
        events[7] = {"ph": "M", "name": "process_name", "pid": 1, "args": {"name": "é\ud83d"}}
        events[9]["dur"] = float("nan")
        text = json.dumps({"schemaVersion": 1, "distributedInfo": {"rank": rank, "backend": "nccl", "world_size": 2}, "traceEvents": events, "baseTimeNanoseconds": 10**18 + rank, "traceName": "t"})
        (path / f"r{rank}.json").write_text(text)
    with gzip.open(path / "a.json.gz", "wt") as file:
        file.write(text)
    return str(path)


def test_equals_reading_documents_whole(spark, folder):
    docs = spark.read.schema(chrome.SCHEMA).option("multiLine", True).json(f"{folder}/r*.json")
    whole = docs.select(F.col("distributedInfo.rank").alias("rank"), F.posexplode("traceEvents").alias("index", "e")).select("rank", F.col("index").cast("long").alias("index"), "e.*")
    plain = lambda df: sorted(map(str, df.where("index <> 7").withColumn("args", F.to_json("args")).na.fill(-1.0).collect()))
    want = plain(whole)
    assert len(want) == 5998
    assert plain(chrome.raw_events(spark, folder, split_bytes=7000).select(*whole.columns)) == want
    both = chrome.raw_events(spark, folder, every_file=True)
    assert both.groupBy("path").count().count() == 3 and both.where("path like '%.gz'").agg(F.max("index"), F.count("*")).first() == (2999, 3000)


def test_metadata_before_and_after_the_events(spark, folder):
    rows = chrome.metadata(spark, folder, split_bytes=9000).orderBy("path").collect()
    assert [(r["rank"], r.baseTimeNanoseconds, r.distributedInfo.backend, r.traceName) for r in rows] == [(1, 10**18 + 1, "nccl", "t"), (0, 10**18, "nccl", "t"), (1, 10**18 + 1, "nccl", "t")]
    assert {r["rank"]: r.path.rsplit("/")[-1] for r in chrome.trace_files(spark, folder).collect()} == {0: "r0.json", 1: "r1.json"}


def test_what_options_leave_out_keeps_positions(spark, folder):
    raw = chrome.raw_events(spark, folder, 20_000, skip_categories=("kernel", "python_function"), args=("stream",))
    rows = raw.where("rank = 0 and cat = 'cpu_op'").collect()
    assert rows and all(r.name == f"n{r['index']}" for r in rows)
    assert raw.where("cat in ('kernel', 'python_function')").count() == 0
    assert {json.dumps(sorted(json.loads(str(r.args.toJson())))) for r in rows if r.args is not None} == {'["stream"]'}
    options = chrome.ParserOptions(skip_categories=("kernel",)).only("stream", "correlation")
    key = lambda df: sorted(map(tuple, df.drop("dur", "end").collect()))
    assert key(chrome.read_events(spark, folder, options, 20_000)) == key(chrome.parse(chrome.raw_events(spark, folder), options))


def test_ranges_that_disagree_are_an_error(spark, tmp_path):
    """An argument that looks like an event, with a cut just before it: the range would start there."""
    inner = [{"ph": "X", "name": "not an event"}] * 200
    events = [{"ph": "X", "name": "outer", "ts": 1, "args": {"list": inner}}, {"ph": "X", "name": "last", "ts": 2}]
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": events}))
    assert chrome.raw_events(spark, str(tmp_path)).count() == 2
    with pytest.raises(PySparkException, match="disagree|no "):
        chrome.raw_events(spark, str(tmp_path), split_bytes=1000).collect()

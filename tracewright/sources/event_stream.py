"""Traces of any size, event by event: a data source that never holds more than a buffer of a file.

Plain files are cut into byte ranges. A range starts anywhere; its reader takes up
at the first object after a comma or bracket that decodes to an event, which text within a
string can't do as quotes are escaped there. What each range found as its first event and as the
first one past its end is compared with its neighbours', so a wrong start is an
error and no wrong row. Compressed files are one range.

    spark.dataSource.register(EventStream)
    spark.read.format("trace_events").option("splitBytes", 64 << 20).load("traces/")
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads, bytes read at a time, and events of a batch.
SPLIT, CHUNK, BATCH = 128 << 20, 1 << 20, 4096
FIELDS = ("ph", "cat", "name", "pid", "tid", "ts", "dur", "id", "bp", "s", "args")
EVENTS = "path string, split int, position long, ph string, cat string, name string, pid string, tid string, ts double, dur double, id string, bp string, s string, args string"
RANGES = "path string, split int, first long, next long, events long, metadata string"
#: Numbers that JSON doesn't have, such as NaN, are null.
_DECODER = json.JSONDecoder(parse_constant=lambda _: None)
_SPACE = re.compile(r"[ \t\r\n]*")
_START = re.compile(r"[,\[][ \t\r\n]*(?=\{)")


class Malformed(ValueError):
    """Text that is no trace; says where."""


class Text:
    """A file from a byte on as text, of which only what is under way is kept."""

    def __init__(self, read: Callable[[int], bytes], at: int = 0, whole: bool = True):
        self._read, self._decode = read, codecs.getincrementaldecoder("utf-8")()
        self.buffer, self.here, self.ended = "", 0, False
        self.counted, self.at = 0, at  # byte `at` is where character `counted` of the buffer lies
        if not whole:  # in the middle of a character
            first = read(CHUNK)
            skipped = next((k for k, b in enumerate(first[:4]) if b & 0xC0 != 0x80), len(first))
            self.at += skipped
            self.ended = not first
            self.buffer = self._decode.decode(first[skipped:])

    def more(self) -> bool:
        """Read on; false at the end. The more is kept, the more is read, so that a long value isn't tried again too often."""
        if self.ended:
            return False
        self.offset()
        self.buffer, self.here, self.counted = self.buffer[self.here :], 0, 0
        data = self._read(max(CHUNK, len(self.buffer)))
        self.ended = not data
        self.buffer += self._decode.decode(data, final=self.ended)
        return True

    def offset(self) -> int:
        """The byte that comes next."""
        passed = self.buffer[self.counted : self.here]
        self.at += len(passed) if passed.isascii() else len(passed.encode())
        self.counted = self.here
        return self.at

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            self.here = _SPACE.match(self.buffer, self.here).end()
            if self.here < len(self.buffer):
                return self.buffer[self.here]
            if not self.more():
                return ""

    def expect(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise Malformed(f"no {wanted!r} at byte {self.offset()}")
        self.here += 1

    def value(self) -> Any:
        """The next JSON value."""
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.buffer, self.here)
            except json.JSONDecodeError as error:
                if not self._cut_short(error) or not self.more():
                    raise Malformed(f"no JSON value at byte {self.offset()}") from None
                continue
            if end == len(self.buffer) and not isinstance(found, (dict, list, str)) and self.more():
                continue  # a number may go on
            self.here = end
            return found

    def _cut_short(self, error: json.JSONDecodeError) -> bool:
        """Whether the value may just not be all there yet."""
        return not self.ended and (error.pos >= len(self.buffer) - 16 or error.msg.startswith("Unterminated string"))

    def skip_to_event(self) -> int | None:
        """Go to the first event after a comma or bracket; the byte of that, or None if there is no event."""
        while True:
            found = _START.search(self.buffer, self.here)
            if not found:
                tail = re.search(r"[,\[][ \t\r\n]*$", self.buffer)
                self.here = max(self.here, tail.start() if tail else len(self.buffer))
                if not self.more():
                    return None
                continue
            self.here = found.end()
            try:
                value, _ = _DECODER.raw_decode(self.buffer, self.here)
            except json.JSONDecodeError as error:
                if self._cut_short(error):
                    self.here = found.start()
                    self.more()
                continue
            if "ph" in value:
                self.here = found.start()
                at = self.offset()
                self.here = found.end()
                return at


@dataclass
class Found:
    """What a range has besides its events: its first event's byte, that of the first past its end, and the document's other keys."""

    first: int | None = None
    next: int | None = None
    metadata: dict | None = None


def events_of(text: Text, start: int, end: int, found: Found) -> Iterator[dict]:
    """The events whose comma or bracket before them lies in [start, end); the rest that is told of the range is put into `found`."""
    found.metadata = {}
    bare, at = False, None
    if start:
        at = text.skip_to_event()
        if at is None:
            return
    else:
        opening = text.peek()
        bare = opening == "["
        if not bare:
            text.expect("{")
    while True:
        if bare or at is not None:  # within the list of events
            if at is None:
                at = text.offset()
                text.expect("[")
            # `at` is the byte of the bracket or comma before what comes
            while at is not None and text.peek() != "]":
                if found.first is None:
                    found.first = at
                if at >= end:
                    found.next = at
                    return
                event, at = text.value(), None
                if isinstance(event, dict):
                    yield event
                if text.peek() == ",":
                    at = text.offset()
                    text.expect(",")
            text.expect("]")
            at = None
            if bare:
                return
        mark = text.peek()
        if mark == "}" or start and not mark:  # a bare list, of which only its end was seen
            return
        if mark == ",":
            text.here += 1
        key = text.value()
        text.expect(":")
        if key == "traceEvents" and text.peek() == "[":
            at = text.offset()
            text.here += 1
        else:
            found.metadata[key] = text.value()


def _place(path: str):
    """The file system that has a path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def text_of(path: str, start: int = 0) -> Text:
    where, name = _place(path)
    if not path.endswith(".gz"):
        file = where.open_input_file(name)
        file.seek(start)
        return Text(file.read, start, whole=start == 0)
    file, unpack, waiting = where.open_input_stream(name, compression=None), zlib.decompressobj(31), b""

    def read(n: int) -> bytes:
        nonlocal unpack, waiting
        while True:
            data = waiting or file.read(CHUNK)
            if not data:
                return b""
            out = unpack.decompress(data, n)
            waiting = unpack.unconsumed_tail
            if unpack.eof:  # files may hold several members
                waiting, unpack = unpack.unused_data, zlib.decompressobj(31)
            if out:
                return out

    return Text(read)


@dataclass
class Range:
    path: str
    split: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a large file, or small files up to about the same size."""

    ranges: list[Range]


def _number(value: Any) -> float | None:
    try:
        return float(value) if not isinstance(value, bool) else None
    except (TypeError, ValueError):
        return None


def _string(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        option = {k.lower(): v for k, v in options.items()}
        self.path, self.columns = option["path"], schema.fieldNames()
        self.ranges = "events" in self.columns
        self.split = int(option.get("splitbytes", SPLIT))
        self.skip = list(json.loads(option.get("skipcategories", "[]")))
        self.args = json.loads(option["args"]) if "args" in option else None
        self.files = json.loads(option["files"]) if "files" in option else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, name = _place(self.path)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        if self.files is None:
            info = where.get_file_info(name)
            files = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and f.base_name.endswith((".json", ".json.gz"))]
        else:
            files = where.get_file_info([_place(f)[1] for f in self.files])
        made, small, size = [], [], 0
        for file in sorted(files, key=lambda f: f.path):
            cuts = [0] if file.path.endswith(".gz") else list(range(0, max(file.size, 1), self.split))
            own = [Range(prefix + file.path, k, at, (cuts + [1 << 62])[k + 1]) for k, at in enumerate(cuts)]
            if len(own) > 1 or file.size > self.split // 4:
                made += [Ranges([r]) for r in own]
                continue
            small, size = small + own, size + file.size
            if size > self.split // 4 or len(small) >= 64:
                made.append(Ranges(small))
                small, size = [], 0
        return made + [Ranges(small)] * bool(small)

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for one in part.ranges:
            yield from self._read(one)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        found, n = Found(), 0
        rows: list[tuple] = []
        try:
            for event in events_of(text_of(part.path, part.start), part.start, part.end, found):
                n += 1
                if not self.ranges and not (self.skip and event.get("cat") in self.skip):
                    rows.append((part.path, part.split, n - 1, *self._fields(event)))
                    if len(rows) == BATCH:
                        yield self._batch(rows)
                        rows = []
        except Malformed as error:
            raise ValueError(f"{part.path}: {error}") from None
        if self.ranges:
            rows = [(part.path, part.split, found.first, found.next, n, json.dumps(found.metadata))]
        if rows:
            yield self._batch(rows)

    def _fields(self, event: dict) -> tuple:
        args = event.get("args")
        if self.args is not None and isinstance(args, dict):
            args = {k: args[k] for k in self.args if k in args}
        text = None if args is None else json.dumps(args, ensure_ascii=False)
        return (*[_string(event.get(k)) for k in ("ph", "cat", "name", "pid", "tid")], _number(event.get("ts")), _number(event.get("dur")), *[_string(event.get(k)) for k in ("id", "bp", "s")], text)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"split": pa.int32(), "position": pa.int64(), "first": pa.int64(), "next": pa.int64(), "events": pa.int64(), "ts": pa.float64(), "dur": pa.float64()}
        def column(name: str, values: tuple) -> pa.Array:
            try:
                return pa.array(values, kinds.get(name, pa.string()))
            except UnicodeEncodeError:  # half a surrogate pair
                return pa.array([v and v.encode("utf-8", "replace").decode() for v in values], pa.string())

        return pa.RecordBatch.from_arrays([column(k, c) for k, c in zip(self.columns, zip(*rows))], self.columns)


class EventStream(DataSource):
    """Rows EVENTS, or RANGES if that schema is asked for. Options: splitBytes, and as JSON lists skipCategories (to leave out), args (to keep) and files (to read, of those at path)."""

    @classmethod
    def name(cls) -> str:
        return "trace_events"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def _read(spark: SparkSession, path: str, schema: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(EventStream)
    return spark.read.format("trace_events").schema(schema).options(**options).load(path)


def ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT, files: list[str] | None = None) -> DataFrame:
    """(path, split, before, events, metadata): events before each range and in it, and the document's keys but its events.

    Reading it fails if two neighbouring ranges don't agree where the second one's first event is.
    """
    found = _read(spark, path, RANGES, splitBytes=split_bytes, **({} if files is None else {"files": json.dumps(files)}))
    of_file = Window.partitionBy("path").orderBy("split")
    # a range within one event has none of its own and passes on what comes next
    expected = F.last("next", ignorenulls=True).over(of_file.rowsBetween(Window.unboundedPreceding, -1))
    wrong = (F.col("split") > 0) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(expected)
    before = F.coalesce(F.sum("events").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("ranges disagree on where an event starts in "), "path")).cast("long")).otherwise(before)
    return found.select("path", "split", checked.alias("before"), "events", "metadata")


def range_events(spark: SparkSession, path: str, split_bytes: int = SPLIT, skip_categories: tuple[str, ...] = (), args: tuple[str, ...] | None = None, files: list[str] | None = None) -> DataFrame:
    """EVENTS: all events but those of skip_categories, with their position in their range; args is JSON text, cut down to the given keys."""
    options: dict[str, str | int] = {"splitBytes": split_bytes, "skipCategories": json.dumps(skip_categories)}
    options |= {k: json.dumps(v) for k, v in (("args", args), ("files", files)) if v is not None}
    return _read(spark, path, EVENTS, **options)

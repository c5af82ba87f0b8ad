"""Trace documents of any size: a data sink that streams a rank's events into one file.

    spark.dataSource.register(DocumentSink)
    rows.write.format("trace_document").mode("overwrite").save("out/")

Rows are (rank, header, event), each rank's together and in order, as document_rows() deals
them: first one with the document's other keys as a JSON object, then events as JSON
text. A task holds one batch of rows. Documents get their names when all of them are written; until then, and
after a failure, nothing is to be seen of them.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .event_stream import _place

ROWS = "rank long, header string, event string"


@dataclass
class Written(WriterCommitMessage):
    """The unnamed files of a task with the ranks that they are of."""

    files: list[tuple[int, str]]


class _Document:
    """One open document."""

    def __init__(self, folder: str, rank: int, header: str | None):
        where, name = _place(folder)
        where.create_dir(f"{name}/_unnamed", recursive=True)
        self.rank, self.path, self.empty = rank, f"{name}/_unnamed/{uuid.uuid4().hex}", True
        self.file = where.open_output_stream(self.path, compression=None)
        self.text = gzip.GzipFile(fileobj=self.file, mode="wb", compresslevel=5, mtime=0)
        keys = json.loads(header) if header else {"schemaVersion": 1, "distributedInfo": {"rank": rank}}
        keys.pop("traceEvents", None)
        opening = json.dumps(keys)[:-1] + (", " if keys else "")
        self.text.write((opening + '"traceEvents": [\n').encode())

    def add(self, event: str) -> None:
        self.text.write((event if self.empty else ",\n" + event).encode())
        self.empty = False

    def close(self) -> tuple[int, str]:
        self.text.write(b"\n]}\n")
        self.text.close()
        self.file.close()
        return self.rank, self.path


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[int, str]] = []
        open_: _Document | None = None
        for batch in batches:
            for rank, header, event in zip(*(batch.column(c).to_pylist() for c in ("rank", "header", "event"))):
                if open_ is None or open_.rank != rank:
                    if open_:
                        done.append(open_.close())
                    open_ = _Document(self.folder, rank, header)
                if event is not None:
                    open_.add(event)
        if open_:
            done.append(open_.close())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, name = _place(self.folder)
        files = [f for m in messages if m for f in m.files]
        if len({rank for rank, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one rank came in several places")
        if self.overwrite:  # ranks that are not written again go
            from pyarrow import fs

            for old in where.get_file_info(fs.FileSelector(name, allow_not_found=True)):
                if old.base_name.startswith("rank="):
                    where.delete_dir(old.path)
        for rank, path in files:
            where.create_dir(f"{name}/rank={rank}", recursive=True)
            where.move(path, f"{name}/rank={rank}/trace.json.gz")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, name = _place(self.folder)
        where.create_dir(f"{name}/_unnamed", recursive=True)
        where.delete_dir(f"{name}/_unnamed")


class DocumentSink(DataSource):
    """Option path: the folder; a rank's document is rank=<rank>/trace.json.gz within."""

    @classmethod
    def name(cls) -> str:
        return "trace_document"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def document_rows(events: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """ROWS of events (rank, ts, event) and, if given, of metadata (rank, header as a JSON object): ranks together, the header first, then events by time."""
    rows = events.select(F.col("rank").cast("long").alias("rank"), F.lit(None).cast("string").alias("header"), "event", F.col("ts").cast("double").alias("ts"))
    if metadata is not None:
        none = F.lit(None)
        rows = rows.unionByName(metadata.select(F.col("rank").cast("long").alias("rank"), "header", none.cast("string").alias("event"), none.cast("double").alias("ts")))
    dealt = rows.repartition("rank").sortWithinPartitions("rank", F.col("header").isNull(), F.col("ts").asc_nulls_first(), "event")
    return dealt.select("rank", "header", "event")


def write_documents(events: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """One gzip document for each rank, event by event, in place of those at path."""
    events.sparkSession.dataSource.register(DocumentSink)
    document_rows(events, metadata).write.format("trace_document").mode("overwrite").save(path)

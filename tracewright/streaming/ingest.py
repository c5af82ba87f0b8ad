"""Traces that keep arriving: a file stream into the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.args import ParserOptions
from ..sources.chrome import SCHEMA, parse


def trace_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Raw events of new trace files of a folder; a file is read once."""
    docs = spark.readStream.schema(SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    listed = docs.select(F.coalesce("distributedInfo.rank", F.lit(0)).alias("rank"), F.posexplode("traceEvents").alias("index", "e"))
    return listed.select("rank", F.col("index").cast("long").alias("index"), "e.*")


def ingest_stream(spark: SparkSession, path: str, target: str, checkpoint: str, options: ParserOptions = ParserOptions(), once: bool = True) -> StreamingQuery:
    """Append parsed events to a Parquet table by rank; exactly once by the stream's own log. With once it ends after the files now there."""
    writer = parse(trace_stream(spark, path), options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("rank")
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Helpers that several of the corpus operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold few rows as single texts may be long.
BATCH_ROWS = "256"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or on a single machine an own one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; for narrow tables. spark.cleaner.referenceTracking.cleanCheckpoints lets Spark remove them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, label: str) -> str:
    """Write the rows as a Parquet table in the shared folder; the path."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row; equal rows are interchangeable, so it identifies a row when a table is read twice."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast a narrow, already computed table of at most most_rows rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(most_rows + 1)) <= most_rows else df


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows with the largest counts (from 1 on), at most `most` of them and all above some count; only sizes by count come to the driver."""
    bucket = F.floor(F.log2(count) * 16)
    sizes = {r.b: r.n for r in df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # 16 for each power of two
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return df.where(F.lit(False)) if least is None else df.where(bucket >= least)


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as many times as its column `times` says, without that column; no list is longer than about the count's square root."""
    n, side = F.col(times), F.ceil(F.sqrt(times)).cast("long")
    blocks = df.where(n > 0).withColumn("block__", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / side) - 1)))
    here = F.least(side, n - F.col("block__") * side)
    return blocks.withColumn("one__", F.explode(F.sequence(F.lit(1).cast("long"), here))).drop("block__", "one__", times)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Writers: Chrome JSON again, counters and flows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .document_sink import write_documents


def event_json(df: DataFrame, *columns: str) -> DataFrame:
    """(rank, ts, event): rows as Chrome events of kind X with the given columns (all but the base ones by default) as args."""
    base = ["rank", "ts", "dur", "end", "name", "cat", "pid", "tid", "index"]
    args = list(columns) or [c for c, t in df.dtypes if c not in base and t != "variant"]
    event = F.to_json(F.struct(F.lit("X").alias("ph"), "cat", "name", "pid", "tid", "ts", "dur", F.struct(*args).alias("args") if args else F.lit(None).alias("args")))
    return df.select("rank", F.col("ts").cast("double").alias("ts"), event.alias("event"))


def counter_json(df: DataFrame, name: str, value: str, pid: str = "rank") -> DataFrame:
    event = F.to_json(F.struct(F.lit("C").alias("ph"), F.lit(name).alias("name"), F.col(pid).alias("pid"), "ts", F.struct(F.col(value).alias(name)).alias("args")))
    return df.select("rank", F.col("ts").cast("double").alias("ts"), event.alias("event"))


def flow_json(df: DataFrame, name: str, start: tuple[str, str, str], end: tuple[str, str, str], number: str) -> DataFrame:
    """Two events (s and f) for each row; start and end name the columns of pid, tid and ts."""

    def side(ph: str, cols: tuple[str, str, str], more: list[Column]) -> DataFrame:
        fields = [F.lit(ph).alias("ph"), F.lit(name).alias("name"), F.lit(name).alias("cat"), F.col(number).alias("id"), *[F.col(c).alias(k) for c, k in zip(cols, ("pid", "tid", "ts"))]]
        return df.select("rank", F.col(cols[2]).cast("double").alias("ts"), F.to_json(F.struct(*fields, *more)).alias("event"))

    return side("s", start, []).unionByName(side("f", end, [F.lit("e").alias("bp")]))


def process_json(df: DataFrame, label: Column) -> DataFrame:
    """Metadata events that name each rank's process."""
    event = F.to_json(F.struct(F.lit("M").alias("ph"), F.lit("process_name").alias("name"), F.col("rank").alias("pid"), F.struct(label.alias("name")).alias("args")))
    return df.select("rank").distinct().select("rank", F.lit(-1.0).alias("ts"), event.alias("event"))


def write_trace(events: DataFrame, path: str) -> None:
    """Rows (rank, ts, event) as gzip text, a folder for each rank; lines joined by commas within brackets make a trace's event list.

    Each line is an event in order of time; read_lines() and Chrome's JSON-lines
    importers take them as they are. No rank's events are gathered in one row.
    """
    ordered = events.repartition("rank").sortWithinPartitions("rank", "ts").select("rank", "event")
    ordered.write.mode("overwrite").partitionBy("rank").option("compression", "gzip").text(path)


def write_document(events: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """One readable JSON document for each rank from rows (rank, ts, event), of any size; metadata (rank, header) has the documents' other keys."""
    write_documents(events, path, metadata)


def raw_json(raw: DataFrame) -> DataFrame:
    """(rank, ts, event): rows of chrome.raw_events() as the events they were read from. Keys without a column of their own are lost."""

    def value(name: str) -> Column:  # numbers stay numbers
        number = F.col(name).rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$")
        quoted = F.to_json(F.array(name))
        return F.when(number, F.try_parse_json(name)).when(F.col(name).isNotNull(), F.try_parse_json(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))

    fields = [value(c).alias(c) if c in ("pid", "tid", "id") else F.col(c) for c in ("ph", "cat", "name", "pid", "tid", "ts", "dur", "id", "bp", "s", "args")]
    return raw.select("rank", "ts", F.to_json(F.struct(*fields)).alias("event"))


def write_report(df: DataFrame, path: str, digits: int = 3) -> None:
    """CSV with numbers rounded to digits."""
    rounded = df.select(*[F.format_number(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    rounded.write.mode("overwrite").option("header", True).csv(path)


def merged_pipeline_trace(rows: DataFrame) -> DataFrame:
    """Events of a pipeline group: start and length of a step's kernels where it has any, names as they are, one process for each rank."""
    ts = F.when(F.col("first_kernel_start") > 0, F.col("first_kernel_start")).otherwise(F.col("ts"))
    dur = F.when(F.col("kernel_span") > 0, F.col("kernel_span")).otherwise(F.col("dur"))
    placed = rows.withColumns({"ts": ts, "dur": dur, "pid": F.col("rank")})
    return event_json(placed, "num_kernels").unionByName(process_json(rows, F.format_string("rank %d", F.col("rank"))))


def timeline(events: DataFrame, width: int = 40) -> DataFrame:
    """(label, task, start, end, duration) for a timeline: short names, streams as tasks."""
    from ..functions.names import simple_name

    return events.select(
        "rank", simple_name(F.col("name"), width).alias("label"), F.concat_ws(":", F.lpad(F.col("rank").cast("string"), 3, "0"), F.col("stream").cast("string")).alias("task"),
        F.timestamp_micros(F.col("ts").cast("long")).alias("start"), F.timestamp_micros((F.col("ts") + F.col("dur")).cast("long")).alias("end"), F.col("dur").alias("duration"),
    )

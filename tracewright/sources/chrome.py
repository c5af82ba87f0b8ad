"""Chrome-format profiler traces (JSON, gzip too) as one events table with a rank column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.keep import kept
from . import event_stream
from .args import KINDS, REGISTRY, ArgSpec, ParserOptions

EVENT = "ph string, cat string, name string, pid string, tid string, ts double, dur double, id string, bp string, s string, args variant"
SCHEMA = (
    "schemaVersion int, distributedInfo struct<backend:string,rank:int,world_size:int,pg_count:int>, deviceProperties array<variant>, baseTimeNanoseconds bigint, "
    f"traceName string, traceEvents array<struct<{EVENT.replace(' string', ':string').replace(' double', ':double').replace(' variant', ':variant')}>>"
)
# Names that tell a device's maker.
MAKERS = {"AMD": ["hipLaunchKernel", "hipMemcpyAsync", "hipExtModuleLaunchKernel"], "NVIDIA": ["cudaLaunchKernel", "cuLaunchKernel", "cudaMemcpyAsync"], "MTIA": ["runFunction - job_prep_and_submit_for_execution"]}
# Noisy Python frames that may be dropped.
NOISY_PYTHON = (r"<built-in", r"torch/_ops\.py", r".*<lambda>", r".*\bwrapper\b")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file with its metadata, events and path, for changes to small documents as a whole; raw_events() and metadata() read files of any size."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return docs.withColumn("rank", F.coalesce("distributedInfo.rank", F.lit(0)))


META = "schemaVersion int, distributedInfo struct<backend:string,rank:int,world_size:int,pg_count:int>, deviceProperties array<variant>, baseTimeNanoseconds bigint, traceName string"


def metadata(spark: SparkSession, path: str, split_bytes: int = event_stream.SPLIT) -> DataFrame:
    """Metadata of each rank's file, from what stands before and after the events; these are passed over one by one."""
    keys = ["schemaVersion", "distributedInfo", "deviceProperties", "baseTimeNanoseconds", "traceName"]
    found = event_stream.ranges(spark, path, split_bytes).select("path", F.from_json("metadata", META).alias("m"))
    files = found.groupBy("path").agg(*[F.first(f"m.{k}", ignorenulls=True).alias(k) for k in keys])
    return files.select(F.coalesce("distributedInfo.rank", F.lit(0)).alias("rank"), "path", *keys)


def trace_files(spark: SparkSession, path: str) -> DataFrame:
    """(rank, path): of several files of a rank the last by path."""
    return metadata(spark, path).groupBy("rank").agg(F.max("path").alias("path"))


def raw_events(spark: SparkSession, path: str, split_bytes: int = event_stream.SPLIT, skip_categories: tuple[str, ...] = (), args: tuple[str, ...] | None = None, every_file: bool = False, files: list[str] | None = None) -> DataFrame:
    """(rank, index, ph, cat, name, pid, tid, ts, dur, id, bp, s, args): all events with their position in the file.

    Files are read in ranges of split_bytes, event by event (see event_stream); of several files of a rank the last by
    path counts, or all with every_file, which adds path. files names those at path that are read. Events of skip_categories and arguments other than args are passed over while reading.
    """
    cuts = event_stream.ranges(spark, path, split_bytes, files).select("path", "split", "before", F.get_json_object("metadata", "$.distributedInfo.rank").try_cast("int").alias("r"))
    of_file = Window.partitionBy("path")
    cuts = cuts.select("path", "split", "before", F.coalesce(F.max("r").over(of_file), F.lit(0)).alias("rank"))
    if not every_file:
        cuts = cuts.withColumn("last", F.max("path").over(Window.partitionBy("rank"))).where("path = last").drop("last")
    rows = event_stream.range_events(spark, path, split_bytes, skip_categories, args, files)
    met = rows.join(F.broadcast(cuts), ["path", "split"])  # a row for each split_bytes of input
    fields = [F.try_parse_json("args").alias("args") if c == "args" else F.col(c) for c in event_stream.FIELDS]
    return met.select("rank", (F.col("before") + F.col("position")).alias("index"), *fields, *["path"] * every_file)


def read_events(spark: SparkSession, path: str, options: ParserOptions = ParserOptions(), split_bytes: int = event_stream.SPLIT) -> DataFrame:
    """The events table of the traces at path; what the options leave out is not even decoded into columns."""
    raw = raw_events(spark, path, split_bytes, options.skip_categories, tuple(a.raw for a in options.args))
    return parse(raw, options)


def argument(spec: ArgSpec) -> Column:
    """An argument's column: its value, or the default where it is missing or of another type."""
    path = "$[" + '"' + spec.raw.replace('"', '\\"') + '"' + "]"
    value = F.try_variant_get("args", path, KINDS[spec.kind])
    if spec.kind == "Object":
        return value
    if spec.kind in ("Int", "Float"):  # numbers may come as text
        text = F.try_variant_get("args", path, "string")
        value = F.coalesce(value, text.try_cast(KINDS[spec.kind]))
    return F.coalesce(value, F.lit(spec.default))


def parse(raw: DataFrame, options: ParserOptions = ParserOptions()) -> DataFrame:
    """The events table: rows with category and duration, arguments as columns, times in µs. Metadata-only traces give no rows."""
    rows = raw.where(F.col("cat").isNotNull() & F.col("dur").isNotNull() & (F.col("cat") != "Trace"))
    if options.skip_categories:
        rows = rows.where(~F.col("cat").isin(*options.skip_categories))
    if options.drop_gpu_annotations:
        rows = rows.where(F.col("cat") != "gpu_user_annotation")
    for pattern in options.drop_python_functions:
        rows = rows.where(~((F.col("cat") == "python_function") & N.starts_like("name", pattern)))
    if options.max_duration_us is not None:
        rows = rows.where(F.col("dur") <= options.max_duration_us)
    start, end = F.col("ts"), F.col("ts") + F.col("dur")
    if options.round_ns:
        start, end = F.ceil(start), F.floor(end)
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(-1))
    found = rows.select(
        "rank", "index", "cat", "name", number("pid").alias("pid"), number("tid").alias("tid"), F.col("pid").alias("pid_text"), F.col("tid").alias("tid_text"),
        start.alias("ts"), (end - start).alias("dur"), end.alias("end"), *[argument(a).alias(a.name) for a in options.args],
    )
    return found.withColumn("stream", F.col("stream").cast("int")) if "stream" in found.columns else found


def flows(raw: DataFrame) -> DataFrame:
    """Forward/backward flow ends (rank, id, ph, ts, tid, pid)."""
    rows = raw.where((F.col("cat") == "fwdbwd") & F.col("ph").isin("s", "f"))
    return rows.select("rank", "id", "ph", "ts", F.col("tid").try_cast("bigint").alias("tid"), F.col("pid").try_cast("bigint").alias("pid"))


def makers(raw: DataFrame) -> DataFrame:
    """(rank, maker): NVIDIA, AMD, MTIA or UNKNOWN by the launch calls that occur."""
    has = {m: F.max(F.col("name").isin(names)) for m, names in MAKERS.items()}
    return raw.groupBy("rank").agg(F.when(has["MTIA"], "MTIA").when(has["AMD"], "AMD").when(has["NVIDIA"], "NVIDIA").otherwise("UNKNOWN").alias("maker"))


def all_arguments(raw: DataFrame) -> DataFrame:
    """(raw, name, kind, n): every argument key that occurs, its column name and the type of its values."""
    pairs = raw.where("args is not null")
    keys = pairs.select(F.explode(F.map_entries(F.try_variant_get("args", "$", "map<string,variant>"))).alias("a"))
    typed = keys.select(F.col("a.key").alias("raw"), F.schema_of_variant("a.value").alias("kind"))
    return typed.groupBy("raw").agg(F.max("kind").alias("kind"), F.count("*").alias("n")).select("raw", N.arg_name(F.col("raw")).alias("name"), "kind", "n")


def validate(raw: DataFrame, level: str = "standard") -> DataFrame:
    """Problems (rank, problem, n). minimal: base fields; standard: also device rows without stream or correlation; complete: also registered arguments of a wrong type."""
    if level not in ("minimal", "standard", "complete"):
        raise ValueError(level)
    timed = raw.where("ph = 'X'")
    checks = {f"no {c}": F.col(c).isNull() for c in ("ts", "dur", "name", "cat", "pid", "tid")}
    if level != "minimal":
        device = N.starts_like("cat", N.CATEGORY["kernel"])
        checks |= {f"device row without {a}": device & F.try_variant_get("args", f"$.{a}", "bigint").isNull() for a in ("stream", "correlation")}
    if level == "complete":
        for spec in REGISTRY.values():
            if spec.kind in ("Int", "Float"):
                path = f'$["{spec.raw}"]'
                checks[f"{spec.raw} is no number"] = F.try_variant_get("args", path, "string").isNotNull() & F.try_variant_get("args", path, "double").isNull()
    rows = timed.groupBy("rank").agg(F.array(*[F.struct(F.lit(k).alias("problem"), F.count_if(c).alias("n")) for k, c in checks.items()]).alias("found"))
    return rows.select("rank", F.explode("found").alias("f")).select("rank", "f.problem", "f.n").where("n > 0")


MANIFEST = "path string, source_size long, source_time timestamp, rank int"


def _exists(path: str) -> bool:
    from pyarrow import fs

    where, name = event_stream._place(path)
    return where.get_file_info(name).type != fs.FileType.NotFound


def ingest(spark: SparkSession, path: str, target: str, options: ParserOptions = ParserOptions(), split_bytes: int = event_stream.SPLIT) -> DataFrame:
    """Parse the new and changed traces of a folder into Parquet by rank; ranks whose files are unchanged stay as they are.

    The last file of a rank by path wins, be it new or known. All files are read by
    one plan, whole ranks are replaced, and the manifest (path, source_size, source_time, rank of
    each file) is written last: after a crash before that, the next call replaces the same ranks
    again. Only the names of new files, and no list of events or ranks, come to the driver.
    """
    events, manifest = f"{target}/events", f"{target}/_manifest"
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("source_size"), F.col("modificationTime").alias("source_time"))
    known = spark.read.schema(MANIFEST).parquet(manifest) if _exists(manifest) else spark.createDataFrame([], MANIFEST)
    fresh = [r.path for r in listed.join(known, ["path", "source_size", "source_time"], "left_anti").select("path").collect()]
    if fresh:
        plain = event_stream._place(path)[1]
        found = event_stream.ranges(spark, plain if "://" not in path else path, split_bytes, fresh)
        local = F.regexp_extract("path", r"^(?:[a-z0-9]+:(?://[^/]*)?)?(.*)$", 1)
        rank = F.coalesce(F.max(F.get_json_object("metadata", "$.distributedInfo.rank").try_cast("int")), F.lit(0))
        ranks = found.groupBy(local.alias("name")).agg(rank.alias("rank"))
        current = listed.withColumn("name", local)
        entries = kept(current.join(ranks, "name").select("path", "source_size", "source_time", "rank"))
        older = known.join(listed, ["path", "source_size", "source_time"], "left_semi")
        last = entries.withColumn("new", F.lit(True)).unionByName(older.withColumn("new", F.lit(False))).groupBy("rank").agg(F.max(F.struct("path", "new")).alias("l"))
        winners = [r.path for r in last.where("l.new").select("l.path").collect()]
        if winners:
            raw = raw_events(spark, plain if "://" not in path else path, split_bytes, options.skip_categories, tuple(a.raw for a in options.args), files=winners)
            parse(raw, options).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rank").parquet(events)
        entries.write.mode("append").parquet(manifest)
    return spark.read.parquet(events)


def device_ranks(events: DataFrame) -> DataFrame:
    return events.select("rank").distinct().orderBy("rank")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sym_id long, symbol string").option("header", True).csv(path)


def write_symbols(symbols: DataFrame, path: str) -> None:
    symbols.write.mode("overwrite").option("header", True).csv(path)


def repair_text(text: Column) -> Column:
    """JSON text with nulls where values are missing."""
    return F.regexp_replace(F.regexp_replace(text, r":\s*,", ": null,"), r":\s*\}", ": null}")


def keep_and_retag(raw: DataFrame, keep: str | None = None, drop: str | None = None, retag: str = "mooncake.*") -> DataFrame:
    """Events whose names match keep (if given) and not drop; names like retag become user annotations."""
    rows = raw
    if keep:
        rows = rows.where(N.starts_like("name", keep))
    if drop:
        rows = rows.where(~N.starts_like("name", drop))
    return rows.withColumn("cat", F.when(N.starts_like("name", retag), "user_annotation").otherwise(F.col("cat")))


def pipeline_snapshot(events: DataFrame) -> DataFrame:
    """(rank, name, ts, dur, iteration, direction, micro_batch, stage) of steps named like forward_step_mb3_vpp1."""
    pattern = r"^(forward|backward)_step_mb(\d+)_vpp(\d+)$"
    part = lambda k: F.regexp_extract("name", pattern, k)
    return events.where(F.col("name").rlike(pattern)).select("rank", "name", "ts", "dur", "iteration", part(1).alias("direction"), part(2).cast("int").alias("micro_batch"), part(3).cast("int").alias("stage"))


def to_unix_ns(events: DataFrame, meta: DataFrame) -> DataFrame:
    """events with ts_unix_ns; an error for ranks without a base time."""
    base = meta.select(F.col("rank").alias("b_rank"), F.col("baseTimeNanoseconds").alias("base_"))
    joined = events.join(F.broadcast(base), F.col("rank") == F.col("b_rank"), "left")  # one row for each rank
    missing = F.raise_error(F.lit("the trace has no baseTimeNanoseconds")).cast("bigint")
    return joined.withColumn("ts_unix_ns", F.coalesce("base_", missing) + (F.col("ts") * 1000).cast("long")).drop("b_rank", "base_")


def with_rank(docs: DataFrame, rank: Column) -> DataFrame:
    """read_documents() with another rank, in the metadata too."""
    info = F.when(F.col("distributedInfo").isNull(), F.struct(F.lit(None).cast("string").alias("backend"), rank.cast("int").alias("rank"), F.lit(None).cast("int").alias("world_size"), F.lit(None).cast("int").alias("pg_count")))
    info = info.otherwise(F.struct("distributedInfo.backend", rank.cast("int").alias("rank"), "distributedInfo.world_size", "distributedInfo.pg_count"))
    return docs.withColumns({"distributedInfo": info, "rank": rank.cast("int")})


def events_only(docs: DataFrame, path: str) -> None:
    """Traces with their event lists alone, one document for each row, as some viewers want them."""
    docs.select(F.to_json(F.struct("traceEvents")).alias("value")).write.mode("overwrite").text(path)


def copy_with_rank(spark: SparkSession, path: str, target: str, rank: int) -> None:
    """The trace at path (one file) written as a document of another rank, event by event; the rank changes in the metadata too."""
    from .sinks import raw_json, write_document

    raw = raw_events(spark, path, every_file=True).withColumn("rank", F.lit(rank))
    heads = event_stream.ranges(spark, path).where("metadata <> '{}'").select(F.from_json("metadata", "map<string,variant>").alias("m"))
    merged = heads.agg(F.aggregate(F.collect_list("m"), F.create_map().cast("map<string,variant>"), lambda a, b: F.map_concat(a, b)).alias("m"))  # the keys before the events and those after them
    info = F.coalesce(F.from_json(F.to_json(F.col("m")["distributedInfo"]), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    fresh = F.map_concat(F.map_filter(info, lambda k, _: k != "rank"), F.create_map(F.lit("rank"), F.parse_json(F.lit(str(rank)))))
    whole = F.map_concat(F.map_filter("m", lambda k, _: k != "distributedInfo"), F.create_map(F.lit("distributedInfo"), F.parse_json(F.to_json(fresh))))
    write_document(raw_json(raw), target, merged.select(F.lit(rank).alias("rank"), F.to_json(whole).alias("header")))

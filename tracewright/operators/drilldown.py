"""Drill-down into modules: templates of a call tree, matches of its nodes, forward and backward spans and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .quantiles import with_quartiles


def parse_template(text: str) -> list[dict]:
    """Nodes of an indented tree, in order: id, parent (-1 for roots), depth, name pattern, dup, shape, rename.

    Marks after a name: @dup@ for nodes that occur several times under their
    parent, @shape@ for nodes whose shape comes from an ancestor, @word for
    another name in reports.
    """
    nodes: list[dict] = []
    open_: list[tuple[int, int]] = []
    for line in text.splitlines():
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        name, dup, shape = line.strip(), "@dup@" in line, "@shape@" in line
        name = name.replace("@dup@", "").replace("@shape@", "").strip()
        name, _, rename = name.partition("@")
        nodes.append({"id": len(nodes), "parent": open_[-1][1] if open_ else -1, "depth": len(open_), "pattern": name.strip(), "dup": dup, "shape": shape, "rename": rename.strip() or name.strip()})
        open_.append((indent, nodes[-1]["id"]))
    return nodes


def template(spark: SparkSession, text: str) -> DataFrame:
    schema = "id int, parent int, depth int, pattern string, dup boolean, shape boolean, rename string"
    nodes = parse_template(text)
    return spark.createDataFrame([tuple(n[k] for k in ("id", "parent", "depth", "pattern", "dup", "shape", "rename")) for n in nodes], schema)


def match(events: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rank, id, index): host rows whose name matches a node's pattern and that stand below a match of the node's parent.

    The nearest matching ancestor must be of the parent node. nodes has few
    rows and is broadcast; pairs is the call stacks' closure.
    """
    host = events.where("stream = -1").select("rank", "index", "name")
    named = host.join(F.broadcast(nodes), F.expr("name rlike concat('^(?:', pattern, ')')")).select("rank", "index", "id", "parent")
    above = pairs.where("ancestor <> index").select("rank", "index", "ancestor", "level")
    upper = named.select("rank", F.col("index").alias("ancestor"), F.col("id").alias("above_id"))
    met = named.join(above, ["rank", "index"]).join(upper, ["rank", "ancestor"]).where(F.col("above_id") != F.col("id"))
    nearest = met.groupBy("rank", "index", "id", "parent").agg(F.max(F.struct("level", "above_id"))["above_id"].alias("above_id"))
    roots = named.where("parent = -1").select("rank", "id", "index")
    return roots.unionByName(nearest.where(F.col("above_id") == F.col("parent")).select("rank", "id", "index"))


def forward_backward_spans(matched: DataFrame, events: DataFrame, pairs: DataFrame, rollup: DataFrame) -> DataFrame:
    """(rank, id, index, forward, backward): time (ms) from first to last kernel of a match, and of the backward rows linked with rows below it.

    events has fwdbwd_index; rollup has the kernels below each host row.
    """
    spans = rollup.select("rank", "index", "first_kernel_start", "last_kernel_end")
    forward = matched.join(spans, ["rank", "index"], "left").select("rank", "id", "index", ((F.col("last_kernel_end") - F.col("first_kernel_start")) / 1000.0).alias("forward"))
    linked = events.where("fwdbwd = 0 and fwdbwd_index >= 0").select("rank", F.col("index").alias("below"), "fwdbwd_index")
    below = matched.join(pairs.select("rank", F.col("index").alias("below"), F.col("ancestor").alias("index")), ["rank", "index"]).join(linked, ["rank", "below"])
    back = below.join(spans.withColumnRenamed("index", "fwdbwd_index"), ["rank", "fwdbwd_index"])
    back = back.groupBy("rank", "id", "index").agg(((F.max("last_kernel_end") - F.min("first_kernel_start")) / 1000.0).alias("backward"))
    return forward.join(back, ["rank", "id", "index"], "left")


def span_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, q25, q50, q75, max, min, var (sample), count of positive values."""
    found = with_quartiles(df.where(F.col(value) > 0), keys, value, F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.var_samp(value).alias("var"), F.count(value).alias("count"))
    return found.select(*keys, "mean", "q25", "q50", "q75", "max", "min", "var", "count")


def model_report(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Statistics of forward and backward spans by template node, with mean * count as a share of the first root's mean."""
    both = spans.select("id", F.expr("stack(2, 'forward', forward, 'backward', backward) as (direction, span)"))
    stats = span_statistics(both, ["id", "direction"], "span")
    root = stats.where("id = 0").select(F.col("direction").alias("r_"), F.col("mean").alias("root_mean"))
    out = stats.join(F.broadcast(root), F.col("direction") == F.col("r_"), "left").drop("r_")
    share = F.when(F.col("root_mean") > 0, F.col("mean") * F.col("count") / F.col("root_mean"))
    return out.withColumn("mean_percent", share).join(F.broadcast(nodes.select("id", "rename", "depth")), "id")


def dims(column: Column) -> Column:
    """Nested input dimensions as ARRAY<ARRAY<BIGINT>>; null for other values."""
    return F.try_variant_get(column, "$", "array<array<bigint>>")


def gemm_rates(ops: DataFrame) -> DataFrame:
    """ops (input_dims, input_type, kernel_dur_sum, ...) with flops, bytes, tflops and gbps of two-dimensional products; nulls for other shapes."""
    shape = ops.withColumns({"d_": dims(F.col("input_dims")), "t_": F.try_variant_get("input_type", "$[0]", "string")})
    a, b = F.get("d_", F.lit(0)), F.get("d_", F.lit(1))
    fits = (F.size(a) == 2) & (F.size(b) == 2)
    work = N.gemm_work(F.get(a, F.lit(0)), F.get(b, F.lit(1)), F.get(a, F.lit(1)), F.col("kernel_dur_sum"), F.col("t_"))
    return shape.withColumn("w_", F.when(fits, work)).select(*ops.columns, "w_.flops", "w_.bytes", "w_.tflops", "w_.gbps")


def shape_from_ancestor(matched: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """matched with the input dimensions of the innermost ancestor (or row itself) that has any."""
    known = events.where(F.size(dims(F.col("input_dims"))) > 0).select("rank", F.col("index").alias("ancestor"), F.to_json(dims(F.col("input_dims"))).alias("dims"))
    met = matched.join(pairs, ["rank", "index"]).join(known, ["rank", "ancestor"])
    best = met.groupBy("rank", "id", "index").agg(F.max_by("dims", "level").alias("dims"))
    return matched.join(best, ["rank", "id", "index"], "left")


def nth_below(events: DataFrame, pairs: DataFrame, starts: DataFrame, roots: DataFrame, pattern: str, n: int) -> DataFrame:
    """(rank, root, index): of the rows below each root whose names match, the n-th (from 0) in stack order."""
    below = roots.select("rank", F.col("index").alias("ancestor")).join(pairs, ["rank", "ancestor"]).where("index <> ancestor")
    named = below.join(events.where(N.starts_like("name", pattern)).select("rank", "index"), ["rank", "index"]).join(starts.select("rank", "index", "enter"), ["rank", "index"])
    place = F.row_number().over(Window.partitionBy("rank", "ancestor").orderBy("enter")) - 1
    return named.withColumn("p_", place).where(F.col("p_") == n).select("rank", F.col("ancestor").alias("root"), "index")


def join_execution_trace(events: DataFrame, et_nodes: DataFrame, columns: list[str]) -> DataFrame:
    """events with the given columns of their rank's execution-trace node whose rf_id is their external id; null where there is none.

    Ids repeat between ranks; only nodes without a rank column, those of a single rank's trace, are joined by id alone.
    """
    keys = [c for c in ("rank",) if c in et_nodes.columns]
    nodes = et_nodes.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("rf_id").alias("rf_"), *columns).dropDuplicates([*[f"n_{k}" for k in keys], "rf_"])
    same = F.col("external_id") == F.col("rf_")
    for k in keys:
        same = same & (F.col(k) == F.col(f"n_{k}"))
    return events.join(nodes, same, "left").drop("rf_", *[f"n_{k}" for k in keys])


def trim_children(rows: DataFrame) -> DataFrame:
    """Rows (rank, tid, python_id, python_parent_id, ts, dur) cut to the earliest end among them and all their ancestors.

    Each round doubles the distance to the ancestor that a row knows, so the
    number of rounds is the logarithm of the deepest chain. Rounds are kept in
    the checkpoint folder, if the session has one.
    """
    spark = rows.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)
    known = rows.select("rank", "tid", "python_id", (F.col("ts") + F.col("dur")).alias("end_"), F.col("python_parent_id").alias("above_"))
    while not known.where("above_ is not null").isEmpty():
        higher = known.select(F.col("rank").alias("h_rank"), F.col("tid").alias("h_tid"), F.col("python_id").alias("h_id"), F.col("end_").alias("h_end"), F.col("above_").alias("h_above"))
        met = known.join(higher, (F.col("rank") == F.col("h_rank")) & (F.col("tid") == F.col("h_tid")) & (F.col("above_") == F.col("h_id")), "left")
        known = keep(met.select("rank", "tid", "python_id", F.least("end_", F.coalesce("h_end", "end_")).alias("end_"), F.col("h_above").alias("above_")))
    trimmed = rows.join(known.drop("above_"), ["rank", "tid", "python_id"])
    return trimmed.withColumn("dur", F.greatest(F.col("end_") - F.col("ts"), F.lit(0))).select(*rows.columns)

"""Distributed training: rank groups, pipeline schedules, transfers, bubbles, expert-parallel statistics."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rank_groups(spark: SparkSession, sizes: dict[str, int], token: str) -> DataFrame:
    """(token, group_id, pos, rank) of all ranks: sizes by parallelism, the first varying fastest; token joins names with -.

    Ranks that agree in all other digits form a group; positions follow the
    token's digits in the order of sizes.
    """
    chosen = token.split("-")
    if any(t not in sizes for t in chosen):
        raise ValueError(f"unknown parallelism in {token}")
    stride, digits = 1, {}
    for name, size in sizes.items():
        digits[name] = F.floor(F.col("rank") / stride).cast("int") % size
        stride *= size

    def number(names: list[str]) -> Column:
        value, factor = F.lit(0), 1
        for name in names:
            value = value + digits[name] * factor
            factor *= sizes[name]
        return value.cast("int")

    ranks = spark.range(prod(sizes.values())).select(F.col("id").cast("int").alias("rank"))
    return ranks.select(F.lit(token).alias("token"), number([n for n in sizes if n not in chosen]).alias("group_id"), number([n for n in sizes if n in chosen]).alias("pos"), "rank")


def neighbours(groups: DataFrame) -> DataFrame:
    """groups with previous and next rank of the group (around), and whether a rank is first or last."""
    within = Window.partitionBy("token", "group_id").orderBy("pos")
    size = F.count("*").over(Window.partitionBy("token", "group_id"))
    edge = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return groups.withColumns(
        {
            "prev_rank": F.coalesce(F.lag("rank").over(within), F.last("rank").over(edge)),
            "next_rank": F.coalesce(F.lead("rank").over(within), F.first("rank").over(edge)),
            "is_first": F.col("pos") == 0,
            "is_last": F.col("pos") == size - 1,
        }
    )


def warmup(stages: Column, stage: Column, micro_batches: Column, virtual: Column | None = None, group: Column | None = None, overlap: bool = False) -> Column:
    """Warm-up micro-batches of a stage: stages - stage - 1, or with virtual stages twice that plus (virtual - 1) * group; never above all, 1 for one stage."""
    one = F.lit(1)
    if virtual is None:
        found, most = stages - stage - 1, micro_batches
    else:
        found, most = (stages - stage - 1) * 2 + (virtual - 1) * group, micro_batches * virtual
    if overlap:
        found = found + 1
    return F.when(stages == 1, one).otherwise(F.least(found, most))


def schedule_table(spark: SparkSession, micro_batches: int, virtual: int, group: int) -> DataFrame:
    """(position, micro_batch, chunk) of an interleaved schedule: groups of micro-batches pass all chunks one after the other."""
    k = F.col("id")
    block = F.floor(k / (group * virtual))
    width = F.least(F.lit(group), F.lit(micro_batches) - block * group)
    inside = k - block * (group * virtual)
    rows = spark.range(micro_batches * virtual)
    return rows.select(k.alias("position"), (block * group + inside % width).cast("long").alias("micro_batch"), F.floor(inside / width).cast("long").alias("chunk"))


def schedule_order(table: DataFrame, warm: int) -> DataFrame:
    """(step, direction, micro_batch, chunk): warm-up forwards, then forward and backward in turn, then the remaining backwards (chunks reversed)."""
    total, last = F.count("*").over(Window.partitionBy()), F.max("chunk").over(Window.partitionBy())
    wide = table.withColumns({"n_": total, "c_": last})
    p = F.col("position")
    forward = F.when(p < warm, p).otherwise(warm + 2 * (p - warm))
    backward = F.when(p < F.col("n_") - warm, warm + 2 * p + 1).otherwise(F.col("n_") + p)
    both = wide.select(forward.alias("step"), F.lit("forward").alias("direction"), "micro_batch", "chunk").unionByName(
        wide.select(backward.alias("step"), F.lit("backward").alias("direction"), "micro_batch", (F.col("c_") - F.col("chunk")).alias("chunk"))
    )
    return both


def micro_batch_ids(rows: DataFrame) -> DataFrame:
    """Pipeline rows (group, stage, rank, name, ts, index, ...) of a 1F1B schedule, from the first recv_forward on, with forward and backward micro-batch ids.

    A name that contains recv_forward or recv_backward begins the next one, the
    combined calls included.
    """
    order = Window.partitionBy("group", "rank").orderBy("ts", "index").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda part: F.sum(F.col("name").contains(part).cast("int")).over(order) - 1
    return rows.withColumns({"fwd_mb": count("recv_forward"), "bwd_mb": count("recv_backward")}).where("fwd_mb >= 0")


def _role(part: str) -> Column:
    return F.col("name").contains(part)


def link_transfers(rows: DataFrame) -> DataFrame:
    """micro_batch_ids() with comm_time: the smaller kernel span of a send and the receive at the next stage; wait = kernel_span - comm_time.

    A combined call takes part in a forward and a backward transfer; the
    backward one, linked later, sets its time. Rows without partner have 0.
    """

    def pairs(direction: str, shift: int) -> DataFrame:
        # a combined send waits with the receive of the next micro-batch, so sends of a direction are counted on their own
        order = Window.partitionBy("group", "rank").orderBy("ts", "index")
        send = rows.where(_role(f"send_{direction}")).select("group", "rank", "stage", "index", "kernel_span", (F.row_number().over(order) - 1).alias("n_"))
        recv = rows.where(_role(f"recv_{direction}")).select("group", "rank", "stage", "index", "kernel_span", (F.row_number().over(order) - 1).alias("n_"))
        s = send.select("group", (F.col("stage") + shift).alias("to_"), "n_", F.col("rank").alias("s_rank"), F.col("index").alias("s_index"), F.col("kernel_span").alias("s_span"))
        r = recv.select("group", F.col("stage").alias("to_"), "n_", F.col("rank").alias("r_rank"), F.col("index").alias("r_index"), F.col("kernel_span").alias("r_span"))
        met = s.join(r, ["group", "to_", "n_"]).withColumn("comm", F.least("s_span", "r_span"))
        return met.select("group", F.expr("stack(2, s_rank, s_index, r_rank, r_index) as (rank, index)"), "comm")

    forward = pairs("forward", 1).groupBy("group", "rank", "index").agg(F.max("comm").alias("f_"))
    backward = pairs("backward", -1).groupBy("group", "rank", "index").agg(F.max("comm").alias("b_"))
    out = rows.join(forward, ["group", "rank", "index"], "left").join(backward, ["group", "rank", "index"], "left")
    out = out.withColumn("comm_time", F.coalesce("b_", "f_", F.lit(0))).drop("f_", "b_")
    return out.withColumn("wait", F.col("kernel_span") - F.col("comm_time"))


def bubble_report_1f1b(linked: DataFrame, stages: int, micro_batches: int) -> DataFrame:
    """One row for each rank: warm-up, steady and cool-down waits (theoretical and total, ms), transfers, the ideal bubble ratio."""
    ms = lambda c: c / 1000.0
    name, wait, stage = F.col("name"), F.col("wait"), F.col("stage")
    first = lambda what: F.min_by(F.when(name == what, wait), F.when(name == what, F.col("ts")))
    total = lambda *names: F.coalesce(F.sum(F.when(name.isin(*names), wait)), F.lit(0))
    side = name.isin("backward_step", "send_backward", "recv_backward", "send_backward_recv_forward", "send_forward_recv_backward")
    optimizer = linked.where("stage = 0 and name = 'optimizer_step'").groupBy("group").agg(F.min("ts").alias("opt_ts"))
    per = linked.groupBy("group", "rank", "stage").agg(
        first("recv_forward").alias("w_"), total("recv_forward", "send_forward").alias("warm"), first("send_forward_recv_backward").alias("s_"),
        total("send_forward_recv_backward", "send_backward_recv_forward").alias("steady"), total("send_backward", "recv_backward").alias("cool"),
        F.max(F.when(side, F.col("ts") + F.col("dur"))).alias("end_"), F.sum("comm_time").alias("comm"),
    )
    per = per.join(optimizer, "group", "left")
    tail = F.greatest(F.coalesce(F.col("opt_ts") - F.col("end_"), F.lit(0)), F.lit(0))
    warm0 = F.when(stage == 0, 0).otherwise(F.coalesce("w_", F.lit(0)))
    steady0 = F.when(stage == stages - 1, 0).otherwise(F.coalesce("s_", F.lit(0)))
    cool0 = F.when(stage == stages - 1, 0).otherwise(F.col("cool")) + tail
    return per.select(
        "group", "rank", "stage", ms(warm0).alias("warmup_theoretical"), ms(F.col("warm")).alias("warmup_total"), ms(F.col("warm") - warm0).alias("warmup_non_balanced"),
        ms(steady0).alias("steady_theoretical"), ms(F.col("steady")).alias("steady_total"), ms(F.col("steady") - steady0).alias("steady_non_balanced"),
        ms(cool0).alias("cooldown_theoretical"), F.lit(0.0).alias("cooldown_extra"), ms(F.col("comm")).alias("comm_total"),
        F.lit((stages - 1) / (stages - 1 + micro_batches)).alias("ideal_bubble_ratio"),
    )


def idle_intervals(rows: DataFrame) -> DataFrame:
    """Forward and backward steps of annotated rows (group, rank, name, ts, dur, num_kernels, first_kernel_start, kernel_span), with direction and idle.

    idle is the device's gap between a step's first kernel and the last kernel of
    the annotated row with kernels before it, transfers included. A rank's first
    step waits for its first recv_forward, so its idle is that one's host time (0
    without one).
    """
    order = Window.partitionBy("group", "rank").orderBy("first_kernel_start", "ts")
    gap = F.col("first_kernel_start") - F.lag(F.col("first_kernel_start") + F.col("kernel_span")).over(order)
    received = F.when(F.col("name") == "recv_forward", F.struct("ts", "dur"))
    waited = rows.withColumn("first_recv_", F.min(received).over(Window.partitionBy("group", "rank"))["dur"])
    steps = waited.where("num_kernels > 0").withColumn("gap_", gap).where(F.col("name").isin("forward_step", "backward_step"))
    idle = F.when(F.row_number().over(order) == 1, F.coalesce("first_recv_", F.lit(0))).otherwise(F.col("gap_"))
    return steps.withColumns({"idle": idle, "direction": F.substring_index("name", "_", 1)}).drop("gap_", "first_recv_")


def bubble_report_interleaved(steps: DataFrame, stages: int, virtual: int, micro_batches: int, group: int, overlap: bool = False) -> DataFrame:
    """One row for each rank of an interleaved schedule, by position of forwards and backwards (ms). steps has idle; comm_total is the idle time of all steps.

    With w warm-up forwards: the first w + 1 forwards are warm-up, the last w
    backwards cool-down (none if w is 0), what is between steady.
    """
    place = Window.partitionBy("group", "rank", "direction").orderBy("ts")
    count = F.count("*").over(Window.partitionBy("group", "rank", "direction"))
    w = warmup(F.lit(stages), F.col("stage"), F.lit(micro_batches), F.lit(virtual), F.lit(group), overlap)
    rows = steps.withColumns({"k_": F.row_number().over(place), "n_": count, "w_": w})
    forward, idle = F.col("direction") == "forward", F.col("idle")
    cool = ~forward & (F.col("k_") > F.col("n_") - F.col("w_"))
    planned = (stages - F.col("stage") - 1) * virtual
    total = lambda where: (F.coalesce(F.sum(F.when(where, idle)), F.lit(0)) / 1000.0)
    in_plan = cool & (F.col("k_") - (F.col("n_") - F.col("w_")) <= planned)
    return rows.groupBy("group", "rank", "stage").agg(
        total((F.col("stage") > 0) & forward & (F.col("k_") == 1)).alias("warmup_theoretical"), total(forward & (F.col("k_") <= F.col("w_") + 1)).alias("warmup_total"),
        total((F.col("stage") < stages - 1) & ~forward & (F.col("k_") == 1)).alias("steady_theoretical"),
        total((forward & (F.col("k_") > F.col("w_") + 1)) | (~forward & ~cool)).alias("steady_total"),
        total(in_plan).alias("cooldown_theoretical"), total(cool & ~in_plan).alias("cooldown_extra"), total(F.lit(True)).alias("comm_total"),
        F.lit((stages - 1) / micro_batches / virtual).alias("ideal_bubble_ratio"),
    )


def phase_times(rows: DataFrame, names: tuple[str, ...] = ("finalize_model_grads", "step", "logical_and_across_model_parallel_group", "should_run_forward_backward")) -> DataFrame:
    """First duration of each named phase on each rank, ms."""
    return rows.groupBy("group", "rank").agg(*[(F.min_by(F.when(F.col("name") == n, F.col("dur")), F.when(F.col("name") == n, F.col("ts"))) / 1000.0).alias(n) for n in names])


def align_groups(rows: DataFrame) -> DataFrame:
    """Rows with times relative to the earliest start among the group's rows with kernels; groups in which one starts at 0 stay."""
    first = rows.where("num_kernels > 0").groupBy("group").agg(F.min("ts").alias("t0_"))
    return rows.join(F.broadcast(first), "group", "left").withColumn("ts", F.col("ts") - F.coalesce("t0_", F.lit(0))).drop("t0_")


def expert_statistics(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, micro_batch, event): earliest and latest start, and min, max, mean and population deviation of durations over a group's ranks, ms."""
    met = rows.join(F.broadcast(groups.select("group_id", "rank")), "rank")
    ms = lambda c: c / 1000.0
    return met.groupBy("group_id", "micro_batch", "event").agg(
        ms(F.min("ts")).alias("start_min"), ms(F.max("ts")).alias("start_max"), ms(F.min("dur")).alias("dur_min"), ms(F.max("dur")).alias("dur_max"),
        ms(F.avg("dur")).alias("dur_mean"), ms(F.stddev_pop("dur")).alias("dur_std"), F.count_distinct("rank").alias("ranks"),
    )


def expert_wide(stats: DataFrame, events: list[str]) -> DataFrame:
    """The same with one row for each group and micro-batch and columns event_statistic."""
    columns = ["start_min", "start_max", "dur_min", "dur_max", "dur_mean", "dur_std"]
    return stats.groupBy("group_id", "micro_batch").pivot("event", events).agg(*[F.first(c).alias(c) for c in columns])


def expert_problems(stats: DataFrame, ranks: int) -> DataFrame:
    """Groups and events that miss ranks, or whose starts are not above 0."""
    return stats.where((F.col("ranks") != ranks) | (F.col("start_min") <= 0) | F.col("dur_mean").isNull())


def bundles(expert: DataFrame, pipeline: DataFrame) -> DataFrame:
    """(ep_group, pp_groups): the pipeline groups that an expert group's ranks belong to."""
    met = expert.select(F.col("group_id").alias("ep_group"), "rank").join(pipeline.select(F.col("group_id").alias("pp_group"), "rank"), "rank")
    return met.groupBy("ep_group").agg(F.sort_array(F.collect_set("pp_group")).alias("pp_groups"))


def device_timeline(rows: DataFrame) -> DataFrame:
    """(group, rank, direction, micro_batch, stage, start, end): first and last kernel times of each step that has kernels; rows that repeat a step are merged."""
    step = ["group", "rank", "direction", "micro_batch", "stage"]
    busy = rows.where("num_kernels > 0 and first_kernel_start > 0")
    return busy.groupBy(*step).agg(F.min("first_kernel_start").alias("start"), F.max("last_kernel_end").alias("end"), F.count("*").alias("rows"))


def step_spans_from(events: DataFrame, name: str = "pretrain") -> DataFrame:
    """events in which the k-th profiler step of a rank takes start and length of the k-th row of the given name, where there is one."""
    order = Window.partitionBy("rank").orderBy("ts", "index")
    is_step = F.col("name").startswith("ProfilerStep")
    numbered = events.withColumn("k_", F.when(is_step, F.row_number().over(Window.partitionBy("rank", is_step).orderBy("ts", "index"))))
    spans = events.where(F.col("name") == name).select(F.col("rank").alias("s_rank"), F.row_number().over(order).alias("s_k"), F.col("ts").alias("s_ts"), F.col("dur").alias("s_dur"))
    joined = numbered.join(spans, (F.col("rank") == F.col("s_rank")) & (F.col("k_") == F.col("s_k")), "left")
    return joined.withColumns({"ts": F.coalesce("s_ts", "ts"), "dur": F.coalesce("s_dur", "dur")}).select(*events.columns)

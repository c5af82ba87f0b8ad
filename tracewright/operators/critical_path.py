"""The critical path of a rank's window: a dependency graph of starts and ends, its longest path, and what bounds it.

Nodes are the starts (2 * index) and ends (2 * index + 1) of host and device
rows. Edges come from joins and windows; only the search for the longest path
holds one rank's window in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .callstack import _ORDER, THREAD, _points, parents
from .counters import queues_of_kernels
from .dag import longest_path
from .intervals import asof_backward, asof_forward, merge_intervals
from .keep import kept

# Calls that wait for the device, calls that take the runtime's lock, device rows of waiting, and the gap (µs) up to which kernels follow each other.
BLOCKING = ["cudaDeviceSynchronize", "cudaStreamSynchronize", "cudaEventSynchronize", "cudaMemcpy", "cudaMemset", "hipDeviceSynchronize", "hipStreamSynchronize"]
LOCKING = ["cudaHostAlloc", "cudaLaunchKernel", "cudaMemcpyAsync"]
SYNC_ROWS = ["Stream Synchronize", "Context Synchronize", "Stream Sync", "Context Sync", "Event Sync"]
KERNEL_GAP = 1500
OPERATOR, DEPENDENCY, LAUNCH, KERNELS, SYNC = "operator_kernel", "dependency", "launch_delay", "kernel_kernel_delay", "sync_dependency"


def clip(events: DataFrame, annotation: str = "ProfilerStep", instance: int = 0) -> DataFrame:
    """Host rows that start within the instance-th annotation of each rank and last, and the device rows that these launch."""
    named = events.where((F.col("stream") == -1) & F.col("name").startswith(annotation))
    chosen = named.withColumn("p_", F.row_number().over(Window.partitionBy("rank").orderBy("ts", "index")) - 1).where(F.col("p_") == instance)
    window = chosen.select(F.col("rank").alias("w_rank"), F.col("ts").alias("w_ts"), (F.col("ts") + F.col("dur")).alias("w_end"))
    host = events.join(F.broadcast(window), F.col("rank") == F.col("w_rank")).where((F.col("stream") == -1) & (F.col("ts") >= F.col("w_ts")) & (F.col("ts") <= F.col("w_end")) & (F.col("dur") > 0))
    host = host.select(*events.columns)
    launches = host.where("correlation >= 0").select("rank", "correlation").distinct()
    device = events.where(N.is_gpu_stream()).join(launches, ["rank", "correlation"], "left_semi")
    return host.unionByName(device)


def _used(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    host = events.where((F.col("stream") == -1) & F.col("cat").isin("cpu_op", "cuda_runtime", "cuda_driver"))
    device = events.where(N.is_gpu_stream() & (F.col("index_correlation") >= 0) & ~F.col("name").isin(SYNC_ROWS))
    return host, device


def nodes(events: DataFrame) -> DataFrame:
    """(rank, node, index, is_start, ts)."""
    host, device = _used(events)
    rows = host.select("rank", "index", "ts", "dur").unionByName(device.select("rank", "index", "ts", "dur"))
    return rows.select("rank", "index", F.expr("stack(2, 2 * index, true, ts, 2 * index + 1, false, ts + dur) as (node, is_start, ts)"))


def merged_threads(host: DataFrame) -> DataFrame:
    """host with the rows of a rank's autograd thread on its forward thread, where there is exactly one of each."""
    of = lambda part: F.collect_set(F.when(F.col("name").contains(part), F.struct("pid", "tid")))
    found = host.groupBy("rank").agg(of("autograd").alias("b_"), of("forward").alias("f_")).where((F.size("b_") == 1) & (F.size("f_") == 1))
    found = found.select("rank", F.col("b_")[0].alias("b_"), F.col("f_")[0].alias("f_"))
    joined = host.join(F.broadcast(found), "rank", "left")  # one row for each rank
    moved = F.struct("pid", "tid") == F.col("b_")
    return joined.withColumns({"pid": F.when(moved, F.col("f_.pid")).otherwise(F.col("pid")), "tid": F.when(moved, F.col("f_.tid")).otherwise(F.col("tid"))}).drop("b_", "f_")


def _edge(a: Column, b: Column, kind: Column | str, index: Column, dur: Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return ["rank", a.cast("long").alias("a"), b.cast("long").alias("b"), kind.alias("kind"), index.cast("long").alias("index"), dur.cast("long").alias("dur")]


def edges(events: DataFrame, merge_threads: bool = True, zero_weight_launches: bool = False, all_events: DataFrame | None = None) -> DataFrame:
    """(rank, a, b, kind, index, weight) with index the row that an edge's time is put down to. events need index_correlation.

    Weights are differences of time; dependencies, waits and blocking calls weigh 0, and so
    does what leads back in time. Time between two points of a thread is put down to the row that is
    innermost then: the one that has started, the one that ends next, or between an end and a
    start the row around both. The gap between two kernels is put down to
    the earlier one; launches, dependencies and waits to none. zero_weight_launches
    adds launches to kernels that wait for something else. Launch queues are counted over all_events,
    the trace that the window was cut from, if given. Of several edges between two
    nodes one stays, of waits and dependencies those first.
    """
    events = kept(events)
    host, device = _used(events)
    if merge_threads:
        host = kept(merged_threads(host))
    order = Window.partitionBy(*THREAD).orderBy(*_ORDER)
    points = _points(host).join(host.select("rank", "index", "name"), ["rank", "index"])
    opens = F.col("delta_") == 1
    open_before = F.coalesce(F.sum("delta_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    node = 2 * F.col("index") + F.when(opens, 0).otherwise(1)
    locks = F.col("name").isin(LOCKING)
    before = {"prev_": node, "prev_at_": F.col("at_"), "prev_index_": F.col("index"), "prev_opens_": opens, "prev_locks_": locks}
    walked = points.withColumns({"node_": node, "open_": open_before, "enter": F.row_number().over(order)} | {k: F.lag(v).over(order) for k, v in before.items()})
    above = parents(walked.where(opens).select(*THREAD, F.col("open_").alias("depth"), "enter", "index"), THREAD).select("rank", "index", "parent")
    # calls that share the runtime's lock are linked by lock_edges(), unless one has ended before the other starts
    shared = locks & F.col("prev_locks_") & (F.col("prev_opens_") | ~opens)
    walked = walked.where(F.col("prev_").isNotNull() & ~shared)
    walked = walked.join(above, ["rank", "index"], "left")
    kind = F.when(opens & (F.col("open_") == 0), DEPENDENCY).otherwise(OPERATOR)
    blocked = ~opens & F.col("name").isin(BLOCKING)
    owner = F.when(kind == OPERATOR, F.when(F.col("prev_opens_"), F.col("prev_index_")).when(~opens, F.col("index")).otherwise(F.col("parent")))
    cpu = walked.select(*_edge(F.col("prev_"), F.col("node_"), kind, owner, F.when((kind == DEPENDENCY) | blocked, 0).otherwise(F.col("at_") - F.col("prev_at_"))))

    own = device.select(*_edge(2 * F.col("index"), 2 * F.col("index") + 1, OPERATOR, F.col("index"), F.col("dur")))

    stream = Window.partitionBy("rank", "stream").orderBy("ts", "index")
    launches = host.select("rank", F.col("index").alias("l_index"), F.col("ts").alias("l_ts"))
    waits = wait_edges(events)
    waited = waits.groupBy("rank", F.floor(F.col("b") / 2).alias("index")).agg(F.max(F.floor(F.col("a") / 2)).alias("s_index"))
    waited = waited.join(device.select("rank", F.col("index").alias("s_index"), (F.col("ts") + F.col("dur")).alias("s_end_")), ["rank", "s_index"]).drop("s_index")
    rows = device.withColumns({"prev_": F.lag("index").over(stream), "prev_end_": F.lag(F.col("ts") + F.col("dur")).over(stream)}).select("rank", "index", "ts", "prev_", "prev_end_", F.col("index_correlation").alias("l_index"))
    rows = rows.join(launches, ["rank", "l_index"], "left").join(queues_of_kernels(events if all_events is None else all_events), ["rank", "index"], "left").join(waited, ["rank", "index"], "left")
    earlier = lambda x, y: x.isNull() | (x < y)
    idle = F.col("l_ts").isNotNull() & (F.coalesce("q_launch", F.lit(1)) == 1) & (F.coalesce("q_kernel", F.lit(0)) == 0) & earlier(F.col("prev_end_"), F.col("l_ts")) & earlier(F.col("s_end_"), F.col("l_ts"))
    follows = ~idle & F.col("prev_").isNotNull() & (F.col("ts") - F.col("prev_end_") < KERNEL_GAP) & earlier(F.col("s_end_"), F.col("prev_end_"))
    none = F.lit(None)
    launch = lambda dur: _edge(2 * F.col("l_index"), 2 * F.col("index"), LAUNCH, none, dur)
    device_edges = rows.where(idle).select(*launch(F.col("ts") - F.col("l_ts")))
    device_edges = device_edges.unionByName(rows.where(follows).select(*_edge(2 * F.col("prev_") + 1, 2 * F.col("index"), KERNELS, F.col("prev_"), F.col("ts") - F.col("prev_end_"))))
    if zero_weight_launches:
        device_edges = device_edges.unionByName(rows.where(F.col("l_ts").isNotNull() & ~idle).select(*launch(F.lit(0))))

    found = cpu.unionByName(lock_edges(host)).unionByName(own).unionByName(device_edges).unionByName(host_sync_edges(events)).unionByName(waits).withColumn("weight", F.greatest("dur", F.lit(0).cast("long")))
    return found.groupBy("rank", "a", "b").agg(F.min_by(F.struct("kind", "index", "weight"), F.struct(F.col("kind") != SYNC, F.col("kind") != DEPENDENCY, "kind")).alias("e")).select("rank", "a", "b", "e.kind", "e.index", "e.weight")


def lock_edges(host: DataFrame) -> DataFrame:
    """Edges between calls of any thread of a rank that take the runtime's lock, which passes on in the order in which they end.

    Every start leads to the first end after it (its own with its time, another's
    without), and every end to the next point if that is an end too.
    """
    calls = host.where(F.col("name").isin(LOCKING)).select("rank", "index", "ts", "dur")
    points = calls.select("rank", "index", "dur", F.expr("stack(2, ts, 1, ts + dur, 0) as (at, starts)"))
    ended = F.when(F.col("starts") == 0, F.col("index"))
    # from the last row to the first, as a frame that ends at the last row is made anew for each row
    back = Window.partitionBy("rank").orderBy(F.desc("at"), F.desc("index"), "starts")
    seen = points.withColumns(
        {"end_": F.last(ended, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), "next_": F.lag("index").over(back), "next_starts_": F.lag("starts").over(back)}
    )
    own = F.col("end_") == F.col("index")
    taken = seen.where("starts = 1 and end_ is not null").select(*_edge(2 * F.col("index"), 2 * F.col("end_") + 1, F.when(own, OPERATOR).otherwise(DEPENDENCY), F.when(own, F.col("index")), F.when(own, F.col("dur")).otherwise(0)))
    passed = seen.where("starts = 0 and next_starts_ = 0").select(*_edge(2 * F.col("index") + 1, 2 * F.col("next_") + 1, DEPENDENCY, F.lit(None), F.lit(0)))
    return taken.unionByName(passed)


def edge_problems(events: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(rank, a, b, kind, problem) of edges that no sound graph has: those that lead back in time, and waits of a stream for itself."""
    points = nodes(events).join(events.select("rank", "index", "stream"), ["rank", "index"]).select("rank", "node", "ts", "stream")
    side = lambda k: points.withColumnsRenamed({"node": k, "ts": f"{k}_ts", "stream": f"{k}_stream"})
    met = (edges(events) if links is None else links).join(side("a"), ["rank", "a"]).join(side("b"), ["rank", "b"])
    itself = (F.col("kind") == SYNC) & (F.col("a_stream") >= 0) & (F.col("a_stream") == F.col("b_stream"))
    problem = F.when(F.col("b_ts") < F.col("a_ts"), "back in time").when(itself, "sync within a stream")
    return met.select("rank", "a", "b", "kind", problem.alias("problem")).where("problem is not null")


def host_sync_edges(events: DataFrame) -> DataFrame:
    """Edges without weight from the end of the last kernel, of the stream or for a context of every stream, that began before a synchronising call returns."""
    host, device = _used(events)
    sync = events.where(N.is_gpu_stream() & F.col("name").isin(SYNC_ROWS))
    calls = host.select("rank", F.col("index").alias("index_correlation"))
    waits = sync.join(calls, ["rank", "index_correlation"]).select("rank", "stream", (F.col("ts") + F.col("dur")).alias("at"), F.col("index_correlation").alias("call"), F.col("name").startswith("Context").alias("all_"))
    streams = device.select("rank", "stream").distinct()
    waits = waits.where("not all_").drop("all_").unionByName(waits.where("all_").drop("stream", "all_").join(streams, "rank"))
    starts = device.select("rank", "stream", F.col("ts").alias("at"), F.col("index").alias("kernel"))
    met = asof_backward(waits, starts, ["rank", "stream"], ["at"], ["kernel"]).where("v_kernel is not null")
    return met.select(*_edge(2 * F.col("v_kernel") + 1, 2 * F.col("call") + 1, SYNC, F.lit(None), F.lit(0)))


def wait_edges(events: DataFrame) -> DataFrame:
    """Edges without weight between streams: the next kernel on a stream that waits for an event, after what was launched before the event was recorded."""
    host, device = _used(events)
    if "wait_on_stream" not in events.columns:
        return device.where(F.lit(False)).select(*_edge(F.col("index"), F.col("index"), SYNC, F.lit(None), F.lit(0)))
    waiting = events.where((F.col("name") == "cudaStreamWaitEvent") & (F.col("wait_on_stream") >= 0)).select("rank", "ts", F.col("stream_arg").alias("stream") if "stream_arg" in events.columns else F.col("wait_on_stream").alias("stream"), F.col("wait_on_cuda_event_record_corr_id").alias("record"))
    records = host.select("rank", F.col("correlation").alias("record"), F.col("ts").alias("r_ts"))
    starts = device.select("rank", "stream", "ts", "index")
    after = asof_forward(waiting, starts, ["rank", "stream"], ["ts"], ["index"]).where("v_index is not null")
    before = asof_backward(after.join(records, ["rank", "record"]).select("rank", F.col("r_ts").alias("ts"), "v_index"), device.select("rank", "ts", F.col("index").alias("source")), ["rank"], ["ts"], ["source"])
    found = before.where("v_source is not null and v_source <> v_index")
    return found.select(*_edge(2 * F.col("v_source") + 1, 2 * F.col("v_index"), SYNC, F.lit(None), F.lit(0))).distinct()


def cycles(points: DataFrame, links: DataFrame) -> DataFrame:
    """(rank, cycle, node): the nodes that reach themselves, and of those that reach each other the smallest as their cycle's name.

    points has (rank, node, ts), links (rank, a, b). A cycle leads back in time
    somewhere, and lies within the times that edges which don't lead forward span together. Only nodes within such
    islands are looked at: those without predecessors or successors go, round by round,
    and what is left is parted by what it reaches. A sound graph has no island but single times.
    """
    side = lambda k: points.select("rank", F.col("node").alias(k), F.col("ts").alias(f"{k}_ts"))
    timed = links.select("rank", "a", "b").join(side("a"), ["rank", "a"]).join(side("b"), ["rank", "b"])
    back = timed.where("b_ts <= a_ts").select("rank", F.col("b_ts").alias("ts"), F.col("a_ts").alias("end"))
    islands = merge_intervals(back, ["rank"])
    placed = asof_backward(points.select("rank", "node", "ts"), islands.select("rank", "ts", F.col("ts").alias("island"), F.col("end").alias("until")), ["rank"], ["ts"], ["island", "until"])
    inside = placed.where("ts <= v_until").select("rank", "node", F.col("v_island").alias("island"))
    of = lambda k: inside.select("rank", F.col("node").alias(k), F.col("island").alias(f"{k}_island"))
    core = kept(timed.join(of("a"), ["rank", "a"]).join(of("b"), ["rank", "b"]).where("a_island = b_island").select("rank", "a", "b").distinct())
    found = None
    while True:
        core = _trimmed(core)
        if core.isEmpty():
            break
        # every node takes the smallest name that reaches it; who reaches its name's owner in turn is on its cycle
        named = _reached(core, core.select("rank", F.col("a").alias("node"), F.col("a").alias("name")).union(core.select("rank", "b", "b")).distinct())
        to, of_a = named.withColumnsRenamed({"node": "b", "name": "b_name"}), named.withColumnsRenamed({"node": "a", "name": "a_name"})
        within = kept(core.join(to, ["rank", "b"]).join(of_a, ["rank", "a"]).where("a_name = b_name").select("rank", F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_name").alias("name")))
        owners = named.where("node = name")
        members = _reached(within.select("rank", "a", "b"), owners)
        found = members if found is None else found.unionByName(members)
        core = kept(core.join(members.select("rank", F.col("node").alias("a")), ["rank", "a"], "left_anti").join(members.select("rank", F.col("node").alias("b")), ["rank", "b"], "left_anti"))
    empty = points.where(F.lit(False)).select("rank", F.col("node").alias("cycle"), "node")
    if found is None:
        return empty
    # an owner that reaches nothing that reaches it is on no cycle, unless by itself
    named = found.select("rank", F.col("name").alias("cycle"), "node")
    size = named.groupBy("rank", "cycle").agg(F.count("*").alias("n"))
    alone = links.where("a = b").select("rank", F.col("a").alias("cycle")).distinct()
    real = size.where("n > 1").select("rank", "cycle").unionByName(alone).distinct()
    return named.join(real, ["rank", "cycle"], "left_semi")


def _trimmed(core: DataFrame) -> DataFrame:
    """Edges without those of nodes that have no predecessor or no successor, until all nodes left have both."""
    left = core.count()
    while left:
        heads, tails = core.select("rank", F.col("b").alias("a")).distinct(), core.select("rank", F.col("a").alias("b")).distinct()
        core = kept(core.join(heads, ["rank", "a"], "left_semi").join(tails, ["rank", "b"], "left_semi"))
        left, before = core.count(), left
        if left == before:
            break
    return core


def _reached(links: DataFrame, names: DataFrame) -> DataFrame:
    """(rank, node, name): the smallest name that reaches each node along links, from nodes with names (rank, node, name) on."""
    before = None
    while True:
        sent = links.join(names.withColumnRenamed("node", "a"), ["rank", "a"]).select("rank", F.col("b").alias("node"), "name")
        names = kept(names.unionByName(sent).groupBy("rank", "node").agg(F.min("name").alias("name")))
        state = names.agg(F.count("*"), F.sum("name")).first()  # rows only grow more, names only smaller
        if state == before:
            return names
        before = state


def critical_path(events: DataFrame, strict: bool = False, links: DataFrame | None = None) -> DataFrame:
    """(rank, node, position, reached, tied) of the longest path of each rank's window. Edges that lead back in time weigh nothing; of edges on a cycle, where no path would end, those are left out.

    strict raises ValueError instead, if any edge has one of edge_problems() or cycles() has rows. links are edges() of the same events, if they are there already.
    """
    points, links = nodes(events), edges(events) if links is None else links
    if strict and (bad := edge_problems(events, links).head(5)):
        raise ValueError(f"unsound edges, such as {[tuple(r) for r in bad]}")
    if strict and (bad := cycles(points, links).head(5)):
        raise ValueError(f"cycles, with nodes such as {[tuple(r) for r in bad]}")
    return longest_path(points.select("rank", "node", F.col("ts").alias("at"), F.lit(0).cast("long").alias("weight")), links, "rank")


def bound_by(kind: Column, device: Column, name: Column, data_loading: list[str] = ()) -> Column:
    """What an edge's time is bound by; data_loading are patterns of host rows that load data."""
    loads = F.lit(False)
    for pattern in data_loading:
        loads = loads | name.rlike(pattern)
    return (
        F.when(kind == LAUNCH, "gpu_kernel_launch_overhead").when(kind == KERNELS, "gpu_kernel_kernel_overhead").when(kind == SYNC, "sync").when(kind == DEPENDENCY, "dependency")
        .when(~device & loads, "data_loading").when(~device, "cpu_bound").when(N.kernel_type(name) == "COMMUNICATION", "gpu_communication_bound").otherwise("gpu_compute_bound")
    )


def breakdown(events: DataFrame, path: DataFrame, data_loading: list[str] = (), links: DataFrame | None = None) -> DataFrame:
    """Edges along the path with their events: (rank, a, b, kind, weight, index, name, cat, bound_by)."""
    order = Window.partitionBy("rank").orderBy("position")
    steps = path.select("rank", F.lag("node").over(order).alias("a"), F.col("node").alias("b")).where("a is not null")
    rows = events.select("rank", "index", "name", "cat", "stream")
    met = steps.join(edges(events) if links is None else links, ["rank", "a", "b"]).join(rows, ["rank", "index"], "left")
    return met.select("rank", "a", "b", "kind", "weight", "index", "name", "cat", bound_by(F.col("kind"), F.col("stream") != -1, F.col("name"), data_loading).alias("bound_by"))


def summary(parts: DataFrame) -> DataFrame:
    """Share of each bound on the path's time."""
    sums = parts.groupBy("rank", "bound_by").agg(F.sum("weight").alias("time"))
    total = F.sum("time").over(Window.partitionBy("rank"))
    return sums.withColumn("percentage", F.when(total > 0, F.round(F.col("time") * 100.0 / total, 2)))


def overlay(events: DataFrame, path: DataFrame) -> DataFrame:
    """(rank, ts, event): the window's rows as Chrome events, those on the path marked, and the path's edges as flows."""
    from ..sources.sinks import event_json, flow_json

    on_path = path.select("rank", F.floor(F.col("node") / 2).alias("index")).distinct().withColumn("critical", F.lit(1))
    rows = event_json(events.join(on_path, ["rank", "index"], "left").na.fill(0, ["critical"]), "critical")
    place = events.select("rank", "index", "pid", "tid", "ts", "dur")
    order = Window.partitionBy("rank").orderBy("position")
    steps = path.select("rank", F.lag("node").over(order).alias("a"), F.col("node").alias("b"), "position").where("a is not null")
    side = lambda n: place.select("rank", F.expr(f"stack(2, 2 * index, ts, 2 * index + 1, ts + dur) as ({n}, {n}_ts)"), F.col("pid").alias(f"{n}_pid"), F.col("tid").alias(f"{n}_tid"))
    flows = steps.join(side("a"), ["rank", "a"]).join(side("b"), ["rank", "b"])
    return rows.unionByName(flow_json(flows, "critical_path", ("a_pid", "a_tid", "a_ts"), ("b_pid", "b_tid", "b_ts"), "position"))


def save(nodes_: DataFrame, edges_: DataFrame, path: str) -> None:
    nodes_.write.mode("overwrite").parquet(f"{path}/nodes")
    edges_.write.mode("overwrite").parquet(f"{path}/edges")


def restore(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def nodes_of_event(points: DataFrame, rank: int, index: int) -> DataFrame:
    """Start and end node of a row."""
    return points.where((F.col("rank") == rank) & (F.col("index") == index))


def events_of_edge(events: DataFrame, rank: int, a: int, b: int) -> DataFrame:
    """The rows at both sides of an edge."""
    return events.where((F.col("rank") == rank) & F.col("index").isin(a // 2, b // 2))

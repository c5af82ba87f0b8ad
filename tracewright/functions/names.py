"""Column functions over event names and categories, and the row predicates of the trace model."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kernel types by name pattern (matched from the start), first match wins.
COMMUNICATION = r"(^nccl.*)|(^hip)|(^hccl)|(.*ncclKernel.*)"
MEMORY = r"(^(hip)?Memcpy)|(^(hip)?Memset)|(^dma)"
NOT_COMPUTATION = (
    r"(^nccl)|(.*Memcpy)|(.*Memset)|(.*dma)|(^.*Sync)|(^Stream Wait Event)|(cuda.*LaunchKernel)|(^runFunction)|(^hip)|(^job_exe)|(^packet)"
    r"|(^pe_exe)|(^cpum_exe_subgraph)|(^hccl)|(^collective_subgraph_execution)"
)
# Category patterns.
CATEGORY = {
    "kernel": r"(kernel)|(gpu_mem.+)|(mtia_ccp_events)",
    "launch": r"(cuda.*LaunchKernel)|(cuLaunchKernel)|(^runFunction)",
    "cpu_op": r"(^cpu_op)|(^user_annotation$)",
    "runtime": r"(cuda_runtime)|(mtia_runtime)",
    "memory": r"(gpu_mem.+)|(mtia_ccp_events)",
    "gpu": r"(.*kernel)|(^gpu_mem)|(^mtia_ccp_events)|(^cuda_sync)",
    "annotation": r"(^gpu_user_annotation)",
    "cpu": r"(^cpu_op)|(^user_annotation$)|(^(.+)_runtime)",
    "cpu_and_gpu": r"(^cpu_op)|(^user_annotation$)|(cuda_runtime)|(.*kernel)|(^gpu_mem)|(^mtia_ccp_events)|(^cuda_sync)",
    "python": r"(python_function)",
    "sync": r"(cuda_sync)",
    "all": r".*",
}
# Runtime calls that launch work on a device.
LAUNCHES = [
    "cudaLaunchKernel", "cudaLaunchKernelExC", "cuLaunchKernel", "cuLaunchKernelEx", "cudaMemcpyAsync", "cudaMemsetAsync",
    "runFunction - job_prep_and_submit_for_execution", "hipLaunchKernel", "hipExtModuleLaunchKernel", "hipMemsetAsync", "hipMemcpyAsync",
    "hipMemcpyWithStream",
]
# Bytes of an element by type name.
ELEMENT_BYTES = {"float": 4.0, "float32": 4.0, "double": 8.0, "half": 2.0, "float16": 2.0, "c10::BFloat16": 2.0, "c10::Half": 2.0, "bfloat16": 2.0, "long": 8.0, "int": 4.0}

# The steps of a pipeline schedule whose rows a report needs, whatever it is, and those that each kind of schedule needs besides.
STEPS_OF_ALL = ["finalize_model_grads", "step", "logical_and_across_model_parallel_group", "reduce_max_stat_across_model_parallel_group", "should_run_forward_backward"]
STEPS_OF = {
    "1f1b": ["forward_step", "backward_step", "recv_forward", "recv_backward", "send_forward", "send_backward", "send_forward_recv_backward", "send_backward_recv_forward"],
    "interleaved": ["forward_step", "backward_step"],
    "interleaved_overlap": ["recv_forward", "recv_backward", "send_forward", "send_backward", "send_forward_recv_forward", "send_backward_recv_backward", "fwdbwd_epoverlap_run"],
}
# Kinds of floating-point instructions that a profiler counts: precision (f, h, d), then what is done.
INSTRUCTIONS = ["ffma", "fmul", "fadd", "hfma", "hmul", "hadd", "dfma", "dmul", "dadd"]


def starts_like(column: Column | str, pattern: str) -> Column:
    """Whether a pattern matches from the start of the value (nulls do not)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.rlike(f"^(?:{pattern})"), F.lit(False))


def kernel_type(name: Column | str) -> Column:
    return (
        F.when(starts_like(name, COMMUNICATION), "COMMUNICATION")
        .when(starts_like(name, MEMORY), "MEMORY")
        .when(~starts_like(name, NOT_COMPUTATION), "COMPUTATION")
        .otherwise("OTHER")
    )


def memory_kernel_type(name: Column) -> Column:
    return F.when(name.startswith("Memset"), "Memset").when(name.startswith("Memcpy"), F.substring(name, 1, 11)).otherwise("Memcpy Unknown")


def iteration_of(name: Column) -> Column:
    """Number of a profiler step's name; null for other names."""
    return F.regexp_extract(name, r"^ProfilerStep\s*#\s*(\d+)", 1).try_cast("bigint")


def arg_name(raw: Column) -> Column:
    """A raw argument name as a column name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def simple_name(name: Column, width: int = 40) -> Column:
    """Name for a timeline: without template and call arguments, cut to a width."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"<.*>", ""), r"\(.*\)", ""), 1, width)


def step_name(prefix: Column, micro_batch: Column, stage: Column) -> Column:
    return F.format_string("%s_mb%d_vpp%d", prefix, micro_batch.cast("long"), stage.cast("long"))


def without_index(name: Column) -> Column:
    return F.regexp_replace(name, r"(_mb\d+)?(_vpp\d+)?$", "")


def short_name(name: Column) -> Column:
    """Name without what stands in <...> and (...), nested ones included, nor ->; of what is left the last word. Names without brackets stay.

    Innermost brackets go in each round; a name has at most as many rounds as brackets that open.
    """
    plain = F.replace(name, F.lit("->"), F.lit(""))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(plain, F.lit("[<(]"))))
    bare = F.aggregate(rounds, plain, lambda left, _: F.regexp_replace(F.regexp_replace(left, "<[^<>]*>", ""), r"\([^()]*\)", ""))
    return F.when(name.rlike("[<(]"), F.substring_index(bare, " ", -1)).otherwise(name)


def short_names(events: DataFrame, column: str = "name", into: str = "short_name") -> DataFrame:
    """events with shortened names; memory kernels keep theirs."""
    return events.withColumn(into, F.when(starts_like(column, MEMORY), F.col(column)).otherwise(short_name(F.col(column))))


# The four predicates for device rows differ on purpose; analyses name the one that they use.
def is_gpu_stream() -> Column:
    return F.col("stream") != -1


def is_gpu_kernel_or_sync() -> Column:
    return ((F.col("stream") >= 0) & (F.col("correlation") >= 0)) | F.col("name").isin("Event Sync", "Context Sync")


def is_gpu_positive() -> Column:
    return F.col("stream") > 0


def is_gpu_correlated() -> Column:
    return (F.col("stream") >= 0) & (F.col("index_correlation") > 0)


def is_operator_or_runtime() -> Column:
    return F.col("cat").isin("cpu_op", "cuda_runtime", "cuda_driver")


def is_launch() -> Column:
    return F.col("name").isin(LAUNCHES) & (F.col("index_correlation") > 0)


def names_contain(patterns: list[str]) -> Column:
    """Any pattern as a plain part of the name."""
    return reduce(lambda a, b: a | b, [F.col("name").contains(p) for p in patterns], F.lit(False))


def names_start_like(patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [starts_like("name", p) for p in patterns], F.lit(False))


def device_type(events: DataFrame, *keys: str, zero_ids: bool = True) -> DataFrame:
    """CPU, GPU or UNKNOWN for each group: GPU if all streams are positive (or, with zero_ids, all pids or all tids are 0), CPU if all are -1."""
    gpu = F.bool_and(F.col("stream") > 0)
    if zero_ids:
        gpu = gpu | F.bool_and(F.col("pid") == 0) | F.bool_and(F.col("tid") == 0)
    return events.groupBy(*keys).agg(F.when(gpu, "GPU").when(F.bool_and(F.col("stream") == -1), "CPU").otherwise("UNKNOWN").alias("device_type"))


def element_bytes(kind: Column) -> Column:
    """Bytes of an element by type name, 1.0 if unknown."""
    return reduce(lambda e, k: e.when(kind == k, ELEMENT_BYTES[k]), ELEMENT_BYTES, F.when(F.lit(False), 0.0)).otherwise(1.0)


def gemm_work(m: Column, n: Column, k: Column, dur_us: Column, kind: Column, batch: Column | None = None) -> Column:
    """STRUCT<flops, bytes, tflops, gbps> of a matrix product (m x k)(k x n); the rates are null for no duration."""
    batch = F.lit(1) if batch is None else batch
    flops = 2.0 * batch * m * n * k
    moved = batch * (m * k + k * n + m * n) * element_bytes(kind)
    rate = lambda x, unit: F.when(dur_us > 0, x / dur_us / unit)
    return F.struct(flops.alias("flops"), moved.alias("bytes"), rate(flops, 1e6).alias("tflops"), rate(moved, 1e3).alias("gbps"))


def attention_flops(batch: Column, heads: Column, queries: Column, keys: Column, width: Column, causal: bool = False) -> Column:
    """Floating-point operations of scores and weighted sum; half for a causal mask."""
    return 4.0 * batch * heads * queries * keys * width * (0.5 if causal else 1.0)


def bubble_ratio(stages: Column, micro_batches: Column, virtual: Column | None = None) -> Column:
    """Ideal share of idle time: (p-1)/(p-1+m), or (p-1)/m/v with virtual stages."""
    return (stages - 1) / (stages - 1 + micro_batches) if virtual is None else (stages - 1) / micro_batches / virtual


def is_schedule_step(name: Column, schedule: str = "1f1b") -> Column:
    """Whether a row is a step, transfer or other span of the given schedule (a key of STEPS_OF): by the start of its name for 1f1b, where names carry more, else by the whole name."""
    wanted = STEPS_OF[schedule] + STEPS_OF_ALL
    if schedule == "1f1b":
        return starts_like(name, "|".join(f"(?:{w})" for w in wanted))
    return F.coalesce(name.isin(wanted), F.lit(False))


def instruction_counter(kind: str) -> str:
    """The profiler's counter of executed instructions of a kind."""
    return f"smsp__sass_thread_inst_executed_op_{kind}_pred_on.sum"


def instruction_flops(counters: list[str], value: Callable[[str], Column] = lambda c: F.col(f"`{c}`")) -> Column:
    """Floating-point operations by counted instructions: fused ones count twice; of the counters only those of INSTRUCTIONS matter, missing values count 0."""
    weights = {instruction_counter(k): 2.0 if k.endswith("fma") else 1.0 for k in INSTRUCTIONS}
    terms = [weights[c] * F.coalesce(value(c).cast("double"), F.lit(0.0)) for c in counters if c in weights]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))

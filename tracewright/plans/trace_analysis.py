"""The analyses of a set of traces behind one object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callstack, compare, counters, critical_path, kernels, silver
from ..operators.keep import kept
from ..sources import chrome, sinks
from ..sources.args import ParserOptions

#: Bucket width of range joins, µs.
WIDTH = 100_000


class TraceAnalysis:
    """Analyses over one events table with a rank column; every method is a DataFrame plan.

    events has rank, index, pid, tid, stream, ts, dur, name, cat and correlation,
    times in µs. from_traces() makes it from a folder of Chrome traces.
    """

    def __init__(self, events: DataFrame, width: int = WIDTH, trim: bool = False, include_last: bool = False):
        if "end" not in events.columns:
            events = events.withColumn("end", F.col("ts") + F.col("dur"))
        rows = silver.align_ranks(events)
        rows = silver.trim_to_steps(rows, include_last) if trim else rows
        self.events = silver.with_iteration(silver.with_index_correlation(rows))
        self.width = width

    @classmethod
    def from_traces(cls, spark: SparkSession, path: str, options: ParserOptions = ParserOptions(), **more) -> TraceAnalysis:
        return cls(chrome.parse(chrome.raw_events(spark, path), options), **more)

    @classmethod
    def from_table(cls, spark: SparkSession, path: str, **more) -> TraceAnalysis:
        """From the Parquet table that sources.chrome.ingest() keeps."""
        return cls(spark.read.parquet(path), **more)

    def stacks(self) -> DataFrame:
        return callstack.call_stacks(self.events)

    def closure(self) -> DataFrame:
        return callstack.closure(callstack.starts_with_depth(self.events))

    def get_comm_comp_overlap(self) -> DataFrame:
        return kernels.communication_overlap(self.events)

    def get_profiler_steps(self) -> DataFrame:
        return compare.profiler_steps(self.events)

    def get_potential_stragglers(self, k: int = 2, find: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The k ranks that most often start late; find may be another function of the events."""
        return find(self.events) if find else compare.stragglers(compare.communication_starts(self.events), k)

    def get_gpu_kernel_breakdown(self, num_kernels: int = 10, duration_ratio: float = 0.8, include_memory_kernels: bool = True) -> tuple[DataFrame, DataFrame]:
        """By kernel type, and by rank, type and name."""
        return kernels.type_breakdown(self.events, include_memory_kernels), kernels.kernel_breakdown(self.events, num_kernels, duration_ratio, include_memory_kernels)

    def get_gpu_kernels_with_user_annotations(self) -> DataFrame:
        return kernels.kernels_with_annotation(self.events, self.width)

    def get_gpu_user_annotation_breakdown(self, use_gpu_annotation: bool = True, num_kernels: int = 1000, allowlist: list[str] = ()) -> DataFrame:
        return kernels.annotation_breakdown(self.events, use_gpu_annotation, num_kernels, always=list(allowlist))

    def get_temporal_breakdown(self) -> DataFrame:
        return kernels.temporal_breakdown(self.events)

    def get_frequent_cuda_kernel_sequences(self, operator_name: str, min_pattern_len: int = 3, top_k: int = 5) -> DataFrame:
        return callstack.frequent_sequences(self.events, self.closure(), operator_name, min_pattern_len, top_k)

    def get_aten_op_kernels_and_delay(self) -> DataFrame:
        return kernels.operator_kernels(self.events, self.width)

    def get_cuda_kernel_launch_stats(self, include_memory_events: bool = False) -> DataFrame:
        return kernels.launch_statistics(self.events, include_memory_events)

    def get_launch_outliers(self, runtime_cutoff: int = 50, launch_delay_cutoff: int = 100) -> DataFrame:
        return kernels.launch_outliers(kernels.launch_statistics(self.events), runtime_cutoff, launch_delay_cutoff)

    def generate_trace_with_counters(self, path: str, queue: bool = True, bandwidth: bool = True) -> None:
        """The events with queue lengths and memory bandwidth as counters, as gzip JSON lines by rank."""
        out = sinks.event_json(self.events)
        if queue:
            out = out.unionByName(sinks.counter_json(counters.queue_series(self.events), "queue_length", "queue_length"))
        if bandwidth and "memory_bw_gbps" in self.events.columns:
            out = out.unionByName(sinks.counter_json(counters.bandwidth_series(self.events), "memory_bw_gbps", "memory_bw_gbps"))
        sinks.write_trace(out, path)

    def get_queue_length_time_series(self) -> DataFrame:
        return counters.queue_series(self.events)

    def get_queue_length_summary(self) -> DataFrame:
        return counters.queue_summary(counters.queue_series(self.events))

    def get_time_spent_blocked_on_full_queue(self, max_queue_length: int = 1024) -> DataFrame:
        return counters.time_blocked(self.events, counters.queue_series(self.events), max_queue_length)

    def get_memory_bw_time_series(self) -> DataFrame:
        return counters.bandwidth_series(self.events)

    def get_memory_bw_summary(self) -> DataFrame:
        return counters.bandwidth_summary(counters.bandwidth_series(self.events))

    def get_idle_time_breakdown(self, consecutive_kernel_delay: int = 30, show_stats: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
        gaps = counters.idle_gaps(self.events, consecutive_kernel_delay)
        return (counters.idle_breakdown(gaps), counters.idle_statistics(gaps)) if show_stats else counters.idle_breakdown(gaps)

    def get_cupti_counter_data_with_operators(self) -> DataFrame:
        return callstack.counters_with_operators(self.events, self.closure())

    def critical_path_analysis(self, annotation: str = "ProfilerStep", instance: int = 0, rank: int | None = None, data_loading: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(path, breakdown of its edges) of each rank, or of the given one; data_loading are patterns of rows that load data."""
        events = self.events if rank is None else self.events.where(F.col("rank") == rank)
        window = kept(critical_path.clip(events, annotation, instance))
        links = kept(critical_path.edges(window, all_events=events))
        path = critical_path.critical_path(window, links=links)
        return path, critical_path.breakdown(window, path, data_loading, links)

    def overlay_critical_path_analysis(self, path: str, annotation: str = "ProfilerStep", instance: int = 0) -> None:
        window = critical_path.clip(self.events, annotation, instance).persist()
        sinks.write_trace(critical_path.overlay(window, critical_path.critical_path(window)), path)

    def compare_with(self, other: TraceAnalysis, rank: int | None = None, iteration: int | None = None, device: str = "all") -> DataFrame:
        return compare.compare_traces(compare.extract(self.events, rank, iteration), compare.extract(other.events, rank, iteration), device)

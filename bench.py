"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "kernel_type_breakdown", "gpu_kernel_stats_by_name", "temporal_breakdown", "comm_comp_overlap", "idle_time_breakdown", "queue_length_summary",
    "memory_bw_summary", "kernel_launch_stats", "aten_op_kernels_delay", "kernels_with_annotation", "iteration_assignment", "trim_last_step",
    "trace_compare", "straggler_metric", "call_stack_parent_depth", "call_stack_kernel_rollup", "cuda_event_asof_prev", "pp_dag_longest_path",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tracewright.plans import catalog

    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first run compiles and is not counted
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        seconds[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, total of the better of two warm runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

import json

from tests.test_sources import trace

from tracewright.plans.fixtures import trace_events
from tracewright.plans.trace_analysis import TraceAnalysis
from tracewright.streaming.ingest import ingest_stream

SF = "/root/testdata/sf0.001"


def test_all_analyses(spark, tmp_path):
    t = TraceAnalysis(trace_events(spark, SF).where("rank < 2 and ts < 300000000000").persist(), width=600_000_000)
    t.events = t.events.persist()
    by_type, by_name = t.get_gpu_kernel_breakdown()
    results = {
        "overlap": t.get_comm_comp_overlap(), "steps": t.get_profiler_steps(), "types": by_type, "names": by_name, "temporal": t.get_temporal_breakdown(),
        "launch": t.get_cuda_kernel_launch_stats(), "queue": t.get_queue_length_summary(), "bandwidth": t.get_memory_bw_summary(), "idle": t.get_idle_time_breakdown(),
        "annotations": t.get_gpu_user_annotation_breakdown(use_gpu_annotation=False), "delay": t.get_aten_op_kernels_and_delay(),
        "sequences": t.get_frequent_cuda_kernel_sequences("aten", 1), "outliers": t.get_launch_outliers(), "compare": t.compare_with(t, 0, 1),
    }
    assert all(df.count() > 0 for df in results.values()), {k: df.count() for k, df in results.items()}
    t.generate_trace_with_counters(str(tmp_path / "counters"))
    assert spark.read.text(str(tmp_path / "counters")).where("value like '%queue_length%'").count() > 0


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for rank in (0, 1):
        (folder / f"{rank}.json").write_text(json.dumps(trace(rank)))
        ingest_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("rank").count().orderBy("rank").collect() == [(0, 5), (1, 5)]

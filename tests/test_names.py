from pyspark.sql import functions as F

from tracewright.functions import names as N


def test_schedule_steps(spark):
    names = ["forward_step", "forward_step_mb1", "recv_forward", "send_forward_recv_forward", "fwdbwd_epoverlap_run", "step", "steps", "aten::mm", None, "should_run_forward_backward"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {s: [r.name for r in df.where(N.is_schedule_step(F.col("name"), s)).collect()] for s in N.STEPS_OF}
    assert got == {
        "1f1b": ["forward_step", "forward_step_mb1", "recv_forward", "send_forward_recv_forward", "step", "steps", "should_run_forward_backward"],
        "interleaved": ["forward_step", "step", "should_run_forward_backward"],
        "interleaved_overlap": ["recv_forward", "send_forward_recv_forward", "fwdbwd_epoverlap_run", "step", "should_run_forward_backward"],
    }


def test_instruction_flops(spark):
    ffma, dadd = N.instruction_counter("ffma"), N.instruction_counter("dadd")
    df = spark.createDataFrame([(10, 3, 100), (None, 4, 100)], [ffma, dadd, "other"])
    assert [r.f for r in df.select(N.instruction_flops(df.columns).alias("f")).collect()] == [23.0, 4.0]
    mapped = spark.createDataFrame([({ffma: 2.0, "x": 9.0},)], "args map<string,double>")
    assert mapped.select(N.instruction_flops([ffma, dadd], lambda c: F.col("args")[c]).alias("f")).first().f == 4.0

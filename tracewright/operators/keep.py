"""Rows that are computed once and whose plan ends there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder and read from there, so that plans that use them often stay small and lost executors cost nothing.

    The folder is spark.checkpoint.dir; only a local session without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracewright-")
        context.setCheckpointDir(folder)
    return df.checkpoint()

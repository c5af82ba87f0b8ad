"""Session settings the library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tracewright", **settings: str) -> SparkSession:
    """A session with UTC times and adaptive execution; settings (with __ for dots) are added."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

"""Trace analytics and data preparation as Spark DataFrame pipelines."""

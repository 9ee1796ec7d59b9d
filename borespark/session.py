"""A session with the settings the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, name: str = "borespark", **options: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow transfer; options override and add."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    } | options
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()

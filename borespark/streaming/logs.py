"""Log functions on streams.

The formulas of ``borespark.functions`` are stateless expressions, so they apply to a streaming DataFrame
unchanged; ``derive`` names what is safe.  Frames over neighbouring rows need the whole log and are
refused here; per-window summaries use event time with a watermark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive(stream: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Stateless curves on a stream or a table."""
    return stream.withColumns(dict(columns))


def window_summary(stream: DataFrame, keys: list[str], time: str, value: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, mean, least and greatest value per key and event-time window; rows later than ``late`` are left out."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return rows.select(*keys, F.col("window.start").alias("start"), "n", "mean", "least", "greatest")

"""Incremental counts over arriving invoice lines. An extension: batch tables are what everything else reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Rows and value by key and window; rows later than the watermark are dropped by a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), key, "n", "value")

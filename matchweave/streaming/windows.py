"""Streaming extension: tumbling event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time_col: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per key and window of ``size``. Works on batch and streaming input; a stream drops rows later than ``late``."""
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    return events.groupBy(F.window(time_col, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")

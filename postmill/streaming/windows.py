"""Event-time windows, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Events by type and window; with a watermark the result can be appended to by a stream."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("events")).select(
        "event_type", F.col("w.start").cast("timestamp").alias("window_start"), "events")

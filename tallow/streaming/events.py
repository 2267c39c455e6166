"""Event streams (beyond the batch operators): windowed counts with watermarks, deduplication, idle state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Streams take event times of type TIMESTAMP only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by window and type; batch and stream alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    events = timed(events).withWatermark("ts", late)
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])

"""Run-history counts as a stream: an addition, as the reference has no stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """day, event_type, n of an event stream (ts, event_type); a day is complete when the watermark passes it, and state is dropped then."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")

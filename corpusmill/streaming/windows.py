"""Windowed counts that work on a table and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, users: tumbling windows; on a stream, rows later than `late` are dropped and users are approximate."""
    if events.isStreaming:
        users = F.approx_count_distinct("user_id")
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    else:
        users = F.count_distinct("user_id")
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), users.alias("users"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "users")

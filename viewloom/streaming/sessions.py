"""Structured Streaming mirrors of the session and count operators; they share schemas with the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Per user and session (events less than `gap` apart): start, end, n, mean. `events` is a stream or a table with ts as a timestamp."""
    own = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy("user_id", own.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def streamed_histogram(events: DataFrame, every: str = "1 day", late: str = "1 hour", width: float = 10.0) -> DataFrame:
    """Per day, event type and bin of values: n."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "event_type", F.floor(F.col("value") / width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "event_type", "bin", "n")
    )

"""Streaming forms of two time operators; their batch twins are the same functions on a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hop_windows(events: DataFrame, length: str, hop: str, key: str = "user_id", ts: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(key, begin, n, mean) per window of `length` every `hop`. On a stream, rows later than `late` are dropped."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(key, F.window(ts, length, hop)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(key, F.col("window.start").alias("begin"), "n", "mean")


def sessions(events: DataFrame, gap: str, active, key: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, begin, end, n): runs of active events whose pauses are shorter than `gap`. State is one open session per key."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.where(active).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")

"""Streaming twin of the timeline: fixed windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_counts(events: DataFrame, size: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Texts and rows of each key in tumbling windows; the same code for batch and stream.

    The watermark bounds the state: windows older than ``late`` are final.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        timed.groupBy("video_key", F.window("ts", size).alias("w"))
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_set("text")).alias("texts"))
        .select("video_key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.array_join("texts", " ").alias("texts"))
    )


def rally_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rallies: events of a key with no gap longer than ``gap``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        timed.groupBy("video_key", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("video_key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )

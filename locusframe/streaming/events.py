"""Localizations and events as streams: windowed counts and gap sessions with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums of ``value`` by window and event_type; rows later than the watermark are not counted."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Binding events of each user: runs of rows with no gap as long as ``gap``."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n_locs")).select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n_locs")


def sliding_counts(stream: DataFrame, ts: str, window: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Counts by event_type in overlapping windows, one every ``slide``."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def first_of_each(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows without those that repeat a key within the watermark; state older than that is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)

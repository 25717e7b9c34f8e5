"""The window operators over streams: event-time windows, sessions, and exact duplicates within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, keys: list[str], size: str, lateness: str) -> DataFrame:
    """Counts and sums per window and key; rows later than ``lateness`` are left out by the watermark."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Gap islands in event time."""
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def unique(events: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)

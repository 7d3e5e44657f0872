"""Structured Streaming over event logs: keyed append without repeats, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within ``delay``; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts per time window and group, final once the watermark passes the window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), group).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), group, "n"
    )

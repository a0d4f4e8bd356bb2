"""Incremental deduplication of a stream; an extension, the block store itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Keys with the time of their first row: within the watermark on a stream, over all rows on a table."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys).select(*keys, ts)
    return events.groupBy(*keys).agg(F.min(ts).alias(ts))


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark(ts, delay) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"))

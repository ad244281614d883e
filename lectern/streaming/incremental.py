"""Event tables kept up to date from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts and sums by time window and kind; events later than `late` are left out once their window is closed."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key's first event within the watermark, keep-first by key."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])

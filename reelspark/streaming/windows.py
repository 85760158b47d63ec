"""Streaming forms of scene, pooling and average operators, on event time with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Time stamps without zone as instants, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, keys: list[str], gap: str, late: str, ts: str = "ts") -> DataFrame:
    """Scenes as runs of events without a gap."""
    e = event_time(events, ts).withWatermark(ts, late)
    out = e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def pooled(events: DataFrame, keys: list[str], length: str, late: str, value: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Mean of maximum and average in windows of time; sliding ones trail."""
    e = event_time(events, ts).withWatermark(ts, late)
    out = e.groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(((F.max(value) + F.avg(value)) / 2).alias("pooled"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "pooled", "mean", "std")

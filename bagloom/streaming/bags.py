"""Bag aggregation over streams: a bag is a user's events in a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, key: str, x: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, sum, mean, max, bag_count); works alike on a stream and on a table."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    whole = lambda c: F.when(F.count(x) == F.count(F.lit(1)), c)
    out = grouped.agg(whole(F.sum(x)).alias("sum"), whole(F.avg(x)).alias("mean"), whole(F.max(x)).alias("max"), F.log1p(F.count(F.lit(1)).cast("double")).alias("bag_count"))
    return out.select(F.col("window.start").alias("window_start"), key, "sum", "mean", "max", "bag_count")

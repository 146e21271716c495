"""Structured Streaming over scored entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(entries: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean and deviation of each user's scores in sliding windows; entries later than the watermark are left out."""
    timed = entries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, slide), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))

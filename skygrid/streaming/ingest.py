"""Structured Streaming over delivered readings: repeats dropped, late rows within a watermark, running totals per object and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(stream: DataFrame, delay: str = "30 days", window: str = "1 day", missing: float = -999.0) -> DataFrame:
    """Rain days and totals per variable and window of loaded_at, each reading (object, cell, pos) counted once within the delay.

    stream: grid_obs rows, streaming or not. Rows later than the watermark are left
    out by the engine; NULL and the sentinel are no readings. Over a table the first delivery counts.
    """
    v = F.when(F.col("value") != missing, F.col("value"))
    rows = stream.withColumn("value", v).where(F.col("value").isNotNull() & F.col("loaded_at").isNotNull())
    key = ["object_id", "lon_i", "lat_i", "pos"]
    if stream.isStreaming:
        once = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(key)
    else:
        once = rows.groupBy(*key).agg(F.min("var").alias("var"), F.min("value").alias("value"), F.min("loaded_at").alias("loaded_at"))
    return once.groupBy(F.window("loaded_at", window).alias("w"), "var").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("value") >= 2.5).alias("at_least_2_5"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("window_start"), "var", "readings", "at_least_2_5", "total")

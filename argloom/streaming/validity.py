"""Shares of valid items in windows of event time, the same over a stream and over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validity_rate(items: DataFrame, valid: Column, time: str = "ts", group: str = "event_type", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, group, n, n_valid. Of a stream, rows later than the watermark are left out and finished windows leave the state.

    Rows without a time belong to no window. A null verdict counts as not valid.
    """
    items = items.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a time zone
    if items.isStreaming:
        items = items.withWatermark(time, late)
    rates = items.where(F.col(time).isNotNull()).groupBy(F.window(time, every).alias("w"), group).agg(F.count("*").alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("n_valid"))
    return rates.select(F.col("w.start").alias("window_start"), group, "n", "n_valid")

"""Streaming forms of batch operators; on a finished source each gives what its twin gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def second_bins(stream: DataFrame, time: str, value: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """start, n, low, high, middle of each window."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    out = w.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), "n", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("middle"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n of runs without a longer gap."""
    out = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_texts(stream: DataFrame, time: str, text: str, late: str = "1 hour") -> DataFrame:
    """Rows whose text's hash has not been seen within the watermark."""
    return stream.withColumn("_h", F.sha2(text, 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["_h"]).drop("_h")

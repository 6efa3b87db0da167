"""Streaming aggregates over timed events: tumbling, sliding and session windows with watermarks.

An extension: the same functions work on a table and on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a time with a zone
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """(start, keys, n, total) of windows of the given width."""
    rows = _timed(df, ts, late)
    g = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    rows = _timed(df, ts, late)
    g = rows.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(start, stop, keys, n): stretches of events with less than gap between them."""
    rows = _timed(df, ts, late)
    g = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")

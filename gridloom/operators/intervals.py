"""Streams of labelled frames as runs, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, stream: str, frame: str, kind: str) -> DataFrame:
    """(stream, run, start, end, kind): stretches of frames of one kind, numbered from 1."""
    w = Window.partitionBy(stream).orderBy(frame)
    new = df.select(F.col(stream).alias("stream"), F.col(frame).alias("frame"), F.col(kind).alias("kind"), F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1)).alias("new"))
    runs_ = new.withColumn("run", F.sum("new").over(Window.partitionBy("stream").orderBy("frame")))
    return runs_.groupBy("stream", "run", "kind").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).select("stream", "run", "start", "end", "kind")


def frames(runs_: DataFrame) -> DataFrame:
    """(stream, frame, kind) of runs whose frames are whole numbers."""
    return runs_.select("stream", F.explode(F.sequence("start", "end")).alias("frame"), "kind")


def kind_at(runs_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (stream, frame) with the kind of the run that holds the frame: the last that starts at or
    before it, found in one pass over both, sorted together."""
    both = runs_.select("stream", F.col("start").alias("frame"), "kind", "end", F.lit(0).alias("ask")).unionByName(asked.select("stream", "frame", F.lit(None).cast(dict(runs_.dtypes)["kind"]).alias("kind"), F.lit(None).cast(dict(runs_.dtypes)["end"]).alias("end"), F.lit(1).alias("ask")))
    w = Window.partitionBy("stream").orderBy("frame", "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = both.select("stream", "frame", "ask", F.last("kind", True).over(w).alias("kind"), F.last("end", True).over(w).alias("e"))
    return last.where("ask = 1").select("stream", "frame", F.when(F.col("frame") <= F.col("e"), F.col("kind")).alias("kind"))

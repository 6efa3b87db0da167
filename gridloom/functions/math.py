"""Scalar functions, and soft minimum over a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def d_gaussian(x: Column) -> Column:
    return -x * gaussian(x)


def dd_gaussian(x: Column) -> Column:
    return (x * x - 1) * gaussian(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def d_sigmoid(x: Column) -> Column:
    s = sigmoid(x)
    return s * (1 - s)


def raised_cosine(rolloff: float, x: Column) -> Column:
    """1 inside, a cosine slope of width rolloff around 1/2, 0 outside."""
    a = F.abs(x)
    low, high = (1 - rolloff) / 2, (1 + rolloff) / 2
    return F.when(a <= low, 1.0).when(a <= high, 0.5 * (1 + F.cos(F.lit(math.pi / rolloff) * (a - low)))).otherwise(0.0)


def soft_min(df: DataFrame, row: str, item: str, d: str, sigma: float) -> DataFrame:
    """(row, item, share): exp(-d / sigma**2) over its sum in the row; where all terms vanish, or
    sigma is 0, all on the least d (least item of equal ones)."""
    w = Window.partitionBy(row)
    e = F.exp(-F.col(d) / (sigma * sigma)) if sigma else F.lit(0.0)
    s = df.select(row, item, e.alias("_e"), F.min(F.struct(F.col(d), F.col(item))).over(w).alias("_b")).withColumn("_s", F.sum("_e").over(w))
    hard = F.when(F.col("_b")[item] == F.col(item), 1.0).otherwise(0.0)
    return s.select(row, item, F.when(F.col("_s") > 0, F.col("_e") / F.col("_s")).otherwise(hard).alias("share"))

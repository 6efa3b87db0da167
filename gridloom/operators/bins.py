"""Binning, weighted and hashed counts.

Bin numbers follow the operator's own edge rule, spelled out at each function. All aggregates are
grouped sums with a partial step before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_search(x: Column, edges: Sequence[float]) -> Column:
    """0 to len(edges): how many of the ascending edges are at most x."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= F.lit(float(e)), 1).otherwise(0)
    return out.cast("int")


def bin_sum(df: DataFrame, bin_: str, value: str, start: DataFrame | None = None) -> DataFrame:
    """(bin, value): sums by bin; bin 0 is skipped; start holds accumulators to add to."""
    rows = df.where(F.col(bin_) != 0).select(F.col(bin_).alias("bin"), F.col(value).alias("value"))
    if start is not None:
        rows = rows.unionByName(start.select("bin", "value"))
    return rows.groupBy("bin").agg(F.sum("value").alias("value"))


def weighted_histogram(df: DataFrame, x: str, w: str, edges: Sequence[float]) -> DataFrame:
    """(bin, weight): bins are right-open, the last edge is a bin of its own; values beyond it,
    below the first edge, and NaN are dropped."""
    value = F.col(x)
    keep = ~F.isnan(value.cast("double")) & (value >= float(edges[0])) & (value <= float(edges[-1]))
    return df.where(keep).groupBy(bin_search(value, edges).alias("bin")).agg(F.sum(w).alias("weight"))


def normalised_histogram(df: DataFrame, axes: dict[str, Sequence[float]], w: str | None = None) -> DataFrame:
    """Bins along each axis (1 to edges-1, the last edge folded into the last bin), and the share
    of the weight in each cell that has any."""
    keep, names = F.lit(True), []
    for name, edges in axes.items():
        keep = keep & (F.col(name) >= float(edges[0])) & (F.col(name) <= float(edges[-1]))
        names.append(F.least(bin_search(F.col(name), edges), F.lit(len(edges) - 1)).alias(f"bin_{name}"))
    weight = F.col(w) if w else F.lit(1.0)
    cells = df.where(keep).groupBy(*names).agg(F.sum(weight).alias("w"))
    total = cells.agg(F.sum("w").alias("t"))
    return cells.crossJoin(F.broadcast(total)).select(*(f"bin_{n}" for n in axes), (F.col("w") / F.col("t")).alias("share"))  # one row of totals


def assign_to_bins(x: Column, edges: Sequence[float]) -> Column:
    """1 to len(edges) - 1 inside, that last number on the last edge too, 0 outside."""
    b = bin_search(x, edges)
    return F.when(x > float(edges[-1]), 0).otherwise(F.least(b, F.lit(len(edges) - 1))).cast("int")


def hash_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): how often each combination occurs; a combination of zeros alone isn't allowed and is dropped."""
    some = F.lit(False)
    for k in keys:
        some = some | (F.col(k) != 0)
    return df.where(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hash_find(counts: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with n, the count of its key in counts, 0 if it isn't there."""
    return df.join(counts.select(*keys, "n"), list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def marginal(hist: DataFrame, keep: Sequence[str], value: str) -> DataFrame:
    """The histogram summed over all other dimensions."""
    return hist.groupBy(*keep).agg(F.sum(value).alias(value))


def rescaled(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """df with scaled: value mapped linearly so that its range becomes low to high; null if all are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", F.lit(low) + v * (high - low)).drop("_lo", "_hi")  # one row


def labelled(df: DataFrame, value: str, n: int, first: int = 0) -> DataFrame:
    """df with lbl: n labels from first over the range of value, rounded half away from zero."""
    return rescaled(df, value).withColumn("lbl", (F.floor(F.col("scaled") * (n - 1) + 0.5) + first).cast("int")).drop("scaled")


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """One row (threshold_bin, between): the cut of a bins-bin histogram with the largest between-class variance."""
    from pyspark.sql import Window

    b = F.least(F.floor(F.col("scaled") * bins), F.lit(bins - 1)).cast("int")
    hist = rescaled(df, value).groupBy(b.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # bins rows at most
    h = hist.select("b", F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col("b")).over(run).alias("m0"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("w"), F.sum(F.col("n") * F.col("b")).over(Window.partitionBy(F.lit(1))).alias("m"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1
    h = h.where(w1 > 0).select("b", (F.col("w0") / F.col("w") * w1 / F.col("w") * gap * gap).alias("between"))
    return h.orderBy(F.desc(F.round("between", 9)), "b").limit(1).select(F.col("b").alias("threshold_bin"), "between")

"""Split search, ferns and application of trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fern_index(x: Column, features: Sequence[int], thresholds: Sequence[float]) -> Column:
    """1 + the tests x[f] < t as bits, the first test highest."""
    out = F.lit(1)
    for k, (f, t) in enumerate(zip(features, thresholds, strict=True)):
        out = out + F.when(F.get(x, F.lit(f)) < t, 1 << (len(features) - 1 - k)).otherwise(0)
    return out


def fern_train(rows: DataFrame, ferns: Sequence[tuple[Sequence[int], Sequence[float]]], bayes: float = 1.0) -> DataFrame:
    """(fern, leaf, cls, p) of rows (id, x, cls): with bayes above 0 the log of the class's share of
    leaves, each leaf with bayes more; else the leaf's share of classes."""
    kinds = rows.select("cls").distinct()
    leaf = F.explode(F.array(*(F.struct(F.lit(k).alias("fern"), fern_index(F.col("x"), f, t).alias("leaf")) for k, (f, t) in enumerate(ferns))))
    n = rows.select("cls", leaf.alias("l")).select("cls", "l.*").groupBy("fern", "leaf", "cls").agg(F.count(F.lit(1)).alias("n"))
    depth = len(ferns[0][0])
    full = rows.sparkSession.range(len(ferns) << depth).select((F.col("id") / (1 << depth)).cast("int").alias("fern"), (F.col("id") % (1 << depth) + 1).cast("int").alias("leaf")).join(F.broadcast(kinds), F.lit(True))
    n = full.join(n, ["fern", "leaf", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + abs(bayes))
    if bayes > 0:
        return n.select("fern", "leaf", "cls", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("fern", "cls"))).alias("p"))
    return n.select("fern", "leaf", "cls", (F.col("n") / F.sum("n").over(Window.partitionBy("fern", "leaf"))).alias("p"))


def fern_apply(rows: DataFrame, table: DataFrame, ferns: Sequence[tuple[Sequence[int], Sequence[float]]]) -> DataFrame:
    """(id, cls): the class with the largest sum over ferns, the least of equal ones."""
    leaf = F.explode(F.array(*(F.struct(F.lit(k).alias("fern"), fern_index(F.col("x"), f, t).alias("leaf")) for k, (f, t) in enumerate(ferns))))
    at = rows.select("id", leaf.alias("l")).select("id", "l.*")
    s = at.join(F.broadcast(table), ["fern", "leaf"]).groupBy("id", "cls").agg(F.round(F.sum("p"), 9).alias("p"))
    return s.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("p"), "cls")).alias("b")).select("id", F.col("b.cls").alias("cls"))


def best_split(rows: DataFrame, criterion: str = "gini", gap: float = 1e-6) -> DataFrame:
    """(f, threshold, score) of rows (f, x, cls): for each feature the threshold between neighbouring
    values (at least gap apart) with the least impurity: gini, entropy or twoing. Ties: the least threshold.

    Equal values are summed first, so a feature's window runs over its distinct values.
    """
    n = rows.groupBy("f", "x", "cls").agg(F.count(F.lit(1)).cast("double").alias("n"))
    kinds = n.select("cls").distinct()
    vals = n.select("f", "x").distinct().join(F.broadcast(kinds), F.lit(True))  # classes are few
    n = vals.join(n, ["f", "x", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    run = Window.partitionBy("f", "cls").orderBy("x")
    n = n.withColumn("l", F.sum("n").over(run)).withColumn("t", F.sum("n").over(Window.partitionBy("f", "cls"))).withColumn("next", F.lead("x").over(run))
    n = n.where(F.col("next") - F.col("x") >= gap)
    r = F.col("t") - F.col("l")
    w = n.groupBy("f", "x", "next").agg(F.sum("l").alias("wl"), F.sum(r).alias("wr"), F.sum(F.col("l") * F.col("l")).alias("gl"), F.sum(r * r).alias("gr"), F.collect_list(F.struct(F.col("l").alias("l"), r.alias("r"))).alias("h"))
    wl, wr = F.col("wl"), F.col("wr")
    all_ = wl + wr
    if criterion == "gini":
        score = ((wl - F.col("gl") / wl) + (wr - F.col("gr") / wr)) / all_
    elif criterion == "entropy":
        part = lambda side, total: F.aggregate("h", F.lit(0.0), lambda a, s: a + F.when(s[side] > 0, -s[side] * F.log2(s[side] / total)).otherwise(0.0))
        score = (part("l", wl) + part("r", wr)) / all_
    elif criterion == "twoing":
        diff = F.aggregate("h", F.lit(0.0), lambda a, s: a + F.abs(s["l"] / wl - s["r"] / wr))
        score = -(wl / all_) * (wr / all_) * diff * diff
    else:
        raise ValueError(criterion)
    best = w.select("f", ((F.col("x") + F.col("next")) / 2).alias("threshold"), F.round(score, 9).alias("score"))
    return best.groupBy("f").agg(F.min(F.struct("score", "threshold")).alias("b")).select("f", F.col("b.threshold").alias("threshold"), F.col("b.score").alias("score"))


def apply_tree(x: Column, nodes: Sequence[tuple[int, float, int, float]], node: int = 0) -> Column:
    """One tree as nested conditions. nodes: (feature, threshold, left child or 0, value); the right
    child is next to the left one; x[feature] < threshold goes left."""
    feature, threshold, left, value = nodes[node]
    if not left:
        return F.lit(value)
    return F.when(F.get(x, F.lit(feature)) < threshold, apply_tree(x, nodes, left)).otherwise(apply_tree(x, nodes, left + 1))


def boosted(x: Column, trees: Sequence[Sequence[tuple[int, float, int, float]]]) -> Column:
    """Sum of the trees' values."""
    out = F.lit(0.0)
    for t in trees:
        out = out + apply_tree(x, t)
    return out

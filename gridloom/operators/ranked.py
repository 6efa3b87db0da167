"""Ranked evaluation curves.

Running sums over the whole ranking are taken in two levels: scores are cut into ranges, each range
runs by itself, and the totals of the ranges before it (one row a range) are added. Rows (id, label,
score): label above 0 is positive, below 0 negative, 0 counts as neither. Ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10


def running(df: DataFrame, score: str, tie: str, sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with rank (from 1, by falling score, then tie) and the running sums of ``sums``."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = df.select(F.percentile_approx(score, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bucket = F.lit(0)
    for e in sorted(set(ends)):
        bucket = bucket + F.when(F.col(score) < F.lit(e), 1).otherwise(0)
    rows = df.withColumn("_b", bucket)
    names = {"rank": F.lit(1), **sums}
    local = Window.partitionBy("_b").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *(F.sum(c).over(local).alias(f"_{n}") for n, c in names.items()))
    before = rows.groupBy("_b").agg(*(F.sum(c).alias(f"_t{n}") for n, c in names.items()))
    prior = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = before.select("_b", *(F.coalesce(F.sum(f"_t{n}").over(prior), F.lit(0)).alias(f"_t{n}") for n in names))
    out = inside.join(F.broadcast(before), "_b")
    return out.select(*df.columns, *((F.col(f"_{n}") + F.col(f"_t{n}")).alias(n) for n in names))


def counts(df: DataFrame, include_inf: bool = False) -> DataFrame:
    """(id, label, score, rank, tp, fp, p, n): running and total counts; scores of -inf are never
    retrieved unless include_inf, but their labels count in p and n."""
    total = df.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("p"), F.coalesce(F.sum((F.col("label") < 0).cast("long")), F.lit(0)).alias("n"))
    rows = df if include_inf else df.where(F.col("score") > F.lit(float("-inf")))
    got = running(rows.select("id", "label", "score"), "score", "id", {"tp": (F.col("label") > 0).cast("long"), "fp": (F.col("label") < 0).cast("long")})
    return got.crossJoin(F.broadcast(total))  # one row of totals


def roc(df: DataFrame, include_inf: bool = False) -> DataFrame:
    """Points of the curve after each rank (the one before the first is 0, 1)."""
    c = counts(df, include_inf)
    return c.select("id", "rank", (F.col("tp") / F.greatest(F.col("p"), F.lit(TINY))).alias("tpr"), (1 - F.col("fp") / F.greatest(F.col("n"), F.lit(TINY))).alias("tnr"), "label", "score", "tp", "fp", "p", "n")


def roc_summary(df: DataFrame, include_inf: bool = False) -> DataFrame:
    """One row: auc (staircase), eer (at the last rank where tnr > tpr; null if that is the end)."""
    r = roc(df, include_inf)
    # a step of the false positive rate at a negative, as high as tpr there
    auc = F.sum(F.when(F.col("label") < 0, F.col("tpr") / F.greatest(F.col("n"), F.lit(TINY))).otherwise(0.0))
    last = F.max(F.when(F.col("tnr") > F.col("tpr"), F.struct("rank", "tpr", "tnr")))
    end = F.max("rank")
    first = r.agg(auc.alias("auc"), last.alias("last"), end.alias("end"))
    at = F.coalesce(F.col("last.rank"), F.lit(0))
    nxt = r.select(F.col("rank").alias("_r"), F.col("tpr").alias("_tp"), F.col("tnr").alias("_tn"))
    out = first.join(nxt, F.col("_r") == at + 1, "left")
    # at the crossing the two curves swap; the rate that stayed is the error
    eer = F.when(at == F.col("end"), None).otherwise(F.when(F.col("_tp") == F.coalesce(F.col("last.tpr"), F.lit(0.0)), 1 - F.col("_tp")).otherwise(1 - F.col("_tn")))
    return out.select("auc", eer.alias("eer"))


def pr(df: DataFrame, include_inf: bool = False) -> DataFrame:
    """Points after each rank: precision and recall (before the first: 1 and 0)."""
    c = counts(df, include_inf)
    hit = F.greatest(F.col("tp"), F.lit(TINY))
    return c.select("id", "rank", "label", "tp", "fp", "p", (hit / F.greatest(F.col("tp") + F.col("fp"), F.lit(TINY))).alias("precision"), (F.col("tp") / F.greatest(F.col("p"), F.lit(TINY))).alias("recall"))


def pr_summary(df: DataFrame, include_inf: bool = False) -> DataFrame:
    """One row: auc (trapezoid over recall), ap (mean precision at the positives), ap11."""
    r = pr(df, include_inf)
    # recall moves at positives alone; the point before one has tp - 1 hits and the same misses
    before = F.greatest(F.col("tp") - 1, F.lit(TINY)) / F.greatest(F.col("tp") - 1 + F.col("fp"), F.lit(TINY))
    up = F.col("label") > 0
    p = F.max("p")
    area = F.sum(F.when(up, (F.col("precision") + before) / 2).otherwise(0.0)) / F.greatest(p, F.lit(TINY))
    ap = F.sum(F.when(up, F.col("precision")).otherwise(0.0)) / F.greatest(p, F.lit(TINY))
    best = [F.coalesce(F.max(F.when(F.col("recall") >= F.lit(k / 10), F.col("precision"))), F.lit(0.0)) for k in range(1, 11)]
    top = F.lit(1.0)  # the point before the first rank has precision 1 and recall 0
    ap11 = sum(best, top) / 11
    return r.agg(area.alias("auc"), ap.alias("ap"), ap11.alias("ap11"))


def det(df: DataFrame) -> DataFrame:
    """Miss rate and false alarm rate after each rank."""
    c = counts(df)
    return c.select("id", "rank", (1 - F.col("tp") / F.greatest(F.col("p"), F.lit(TINY))).alias("miss"), (F.col("fp") / F.greatest(F.col("n"), F.lit(TINY))).alias("false_alarm"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n, share): counts, and shares of each true class."""
    c = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("truth").agg(F.sum("n").alias("t"))
    return c.join(t, "truth").select("truth", "guess", "n", (F.col("n") / F.col("t")).alias("share"))


def weighted_median(df: DataFrame, group: str, x: str, w: str) -> DataFrame:
    """(group, median): the first value with over half of the weight up to it; on exactly half, the
    mean with the next one. Equal values are summed first."""
    s = df.groupBy(group, x).agg(F.sum(w).alias("_w"))
    by = Window.partitionBy(group).orderBy(x)
    s = s.select(group, x, F.sum("_w").over(by).alias("_c"), F.lead(x).over(by).alias("_n"), F.sum("_w").over(Window.partitionBy(group)).alias("_t"))
    value = F.when(F.col("_c") * 2 == F.col("_t"), (F.col(x) + F.col("_n")) / 2).otherwise(F.col(x).cast("double"))
    first = s.where(F.col("_c") * 2 >= F.col("_t")).groupBy(group).agg(F.min(F.struct(x, value.alias("m"))).alias("f"))
    return first.select(group, F.col("f.m").alias("median"))

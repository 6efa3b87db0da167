"""Fields of nearest patches and votes from them.

A field has, for each place (y, x) of a source grid, the place (ty, tx) in a target grid whose
square patch of side p is nearest. Grids are rows (r, c, v). Each step is an equi-join on places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patches(grid: DataFrame, p: int) -> DataFrame:
    """(y, x, patch): the p * p values from each place that has them all, row by row."""
    arr = F.array(*(F.struct((F.col("r") - i).alias("y"), (F.col("c") - j).alias("x"), F.lit(i * p + j).alias("k")) for i in range(p) for j in range(p)))
    sent = grid.select(F.explode(arr).alias("t"), "v").select("t.y", "t.x", "t.k", "v")
    g = sent.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a"))
    return g.where(F.size("a") == p * p).select("y", "x", F.transform("a", lambda s: s["v"]).alias("patch"))


def distance(a: Column, b: Column) -> Column:
    """Mean of squared differences."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t) / F.size(a)


def search(source: DataFrame, target: DataFrame, p: int, window: int, own: bool = False) -> DataFrame:
    """(y, x, ty, tx, dist): the nearest target patch within window of each place (ties by ty, tx);
    own: whether the place itself may be taken. A place meets (2 window + 1)^2 others by an equi-join."""
    s, t = patches(source, p), patches(target, p)
    shifts = [(i, j) for i in range(-window, window + 1) for j in range(-window, window + 1) if own or (i, j) != (0, 0)]
    arr = F.array(*(F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i, j in shifts))
    sent = t.select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("patch").alias("tp"), F.explode(arr).alias("z")).select("ty", "tx", "tp", "z.y", "z.x")
    both = s.join(sent, ["y", "x"]).select("y", "x", F.round(distance(F.col("patch"), F.col("tp")), 9).alias("dist"), "ty", "tx")
    return both.groupBy("y", "x").agg(F.min(F.struct("dist", "ty", "tx")).alias("b")).select("y", "x", "b.ty", "b.tx", "b.dist")


def _spread(field: DataFrame, p: int) -> DataFrame:
    """Each patch's cells: source (r, c), target (tr, tc), and the place in the patch."""
    arr = F.array(*(F.struct((F.col("y") + i).alias("r"), (F.col("x") + j).alias("c"), (F.col("ty") + i).alias("tr"), (F.col("tx") + j).alias("tc"), F.lit(i * p + j).alias("k")) for i in range(p) for j in range(p)))
    return field.select("*", F.explode(arr).alias("s")).select(*field.columns, "s.r", "s.c", "s.tr", "s.tc", "s.k")


def occurrences(field: DataFrame, p: int) -> DataFrame:
    """(r, c, n): how many patches cover each target cell."""
    return _spread(field, p).groupBy(F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def coherence(field: DataFrame) -> DataFrame:
    """(y, x, n): neighbours (of four) whose patch is the shifted one."""
    at = field.select("y", "x", "ty", "tx")
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    arr = F.array(*(F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x"), (F.col("ty") + i).alias("ty"), (F.col("tx") + j).alias("tx")) for i, j in steps))
    want = at.select(F.explode(arr).alias("s")).select("s.*").withColumn("hit", F.lit(1))
    both = at.join(want, ["y", "x", "ty", "tx"], "left").groupBy("y", "x").agg(F.count("hit").alias("n"))
    return both


def vote(field: DataFrame, target: DataFrame, p: int, weights: Sequence[float] | None = None) -> DataFrame:
    """(r, c, v, w): weighted mean, by place in the patch, of the target cells that patches bring."""
    w = F.get(F.array(*(F.lit(float(x)) for x in (weights or [1.0] * (p * p)))), F.col("k"))
    t = target.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "v")
    s = _spread(field.select("y", "x", "ty", "tx"), p).join(t, ["tr", "tc"])
    return s.groupBy("r", "c").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"), F.sum(w).alias("w"))


def vote_direct(field: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(r, c, v): each cell takes the first cell of its own patch, or of the last patch there is."""
    ends = field.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    at = source.select("r", "c").crossJoin(F.broadcast(ends)).select("r", "c", F.least("r", "my").alias("y"), F.least("c", "mx").alias("x"))  # one row
    to = at.join(field.select("y", "x", "ty", "tx"), ["y", "x"]).select("r", "c", (F.col("ty") + F.col("r") - F.col("y")).alias("tr"), (F.col("tx") + F.col("c") - F.col("x")).alias("tc"))
    return to.join(target.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "v"), ["tr", "tc"]).select("r", "c", "v")


def vote_median(field: DataFrame, target: DataFrame, p: int) -> DataFrame:
    """(r, c, v): the lower median of the cells that patches bring: the first with half the weight."""
    t = target.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "v")
    s = _spread(field.select("y", "x", "ty", "tx"), p).join(t, ["tr", "tc"])
    w = Window.partitionBy("r", "c").orderBy("v")
    n = s.groupBy("r", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    n = n.select("r", "c", "v", F.sum("n").over(w).alias("run"), F.sum("n").over(Window.partitionBy("r", "c")).alias("all"))
    return n.where(F.col("run") * 2 >= F.col("all")).groupBy("r", "c").agg(F.min("v").alias("v"))


def vote_both_ways(field: DataFrame, back: DataFrame, target: DataFrame, p: int, b: float = 0.5) -> DataFrame:
    """(r, c, v): the votes of field and those of the reverse field (target places, with their source
    places as ty, tx), weighted (1 - b) * R / n and b * R / m for n and m patches, R the larger."""
    n, m = field.count(), back.count()
    big = max(n, m)
    t = target.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "v")
    one = _spread(field.select("y", "x", "ty", "tx"), p).select("r", "c", "tr", "tc", F.lit((1 - b) * big / max(n, 1)).alias("w"))
    turned = back.select(F.col("ty").alias("y"), F.col("tx").alias("x"), F.col("y").alias("ty"), F.col("x").alias("tx"))
    two = _spread(turned, p).select("r", "c", "tr", "tc", F.lit(b * big / max(m, 1)).alias("w"))
    return one.unionByName(two).join(t, ["tr", "tc"]).groupBy("r", "c").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def completeness_penalty(n: Column, weight: float, exponent: float, penalty: float) -> Column:
    """Coverage n to a penalty: over the weight up to 1, times it beyond; then the power, times penalty."""
    return F.pow(F.when(n <= 1, n / weight).otherwise(n * weight), F.lit(exponent)) * penalty

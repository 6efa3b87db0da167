"""Encodings of sets of vectors, and linear models' losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import posteriors


def bag_of_words(assigned: DataFrame, group: str, words: int) -> DataFrame:
    """(group, k, n): how often each word 0 .. words-1 is assigned (k) in each group, zeros included."""
    full = assigned.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("k"))
    n = assigned.groupBy(group, "k").agg(F.count(F.lit(1)).alias("n"))
    return full.join(n, [group, "k"], "left").select(group, "k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def residuals(rows: DataFrame, centres: DataFrame, group: str, normalise_mass: bool = False, square_root: bool = False, normalise_parts: bool = False, normalise: bool = True) -> DataFrame:
    """(group, k, i, v): sums of x - c over the rows (group, k, x) of each centre (k, c); then, as
    asked: over the mass of the centre, signed square roots, unit norm of each centre's part, and
    of the whole (with a floor of 1e-12)."""
    c = F.broadcast(centres.select("k", F.posexplode("c").alias("i", "m")))
    long = rows.select(group, "k", F.posexplode("x").alias("i", "x")).groupBy(group, "k", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = long.join(c, ["k", "i"]).select(group, "k", "i", ((F.col("s") - F.col("n") * F.col("m")) / (F.col("n") if normalise_mass else 1)).alias("v"))
    if square_root:
        out = out.withColumn("v", F.signum("v") * F.sqrt(F.abs("v")))
    for on, by in ((normalise_parts, [group, "k"]), (normalise, [group])):
        if on:
            out = out.withColumn("v", F.col("v") / F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*by))), F.lit(1e-12)))
    return out


def fisher(rows: DataFrame, modes: DataFrame, group: str, improved: bool = False) -> DataFrame:
    """(group, k, part, i, v): gradients of the log-likelihood of each group's rows (group, id, x) by
    the means (part 0) and deviations (part 1) of the modes (k, mean, variance, prior): 2 D K numbers.

    Priors and posteriors under 1e-6 count as none. improved: signed square root and unit norm.
    """
    p = posteriors(rows, modes).where(F.col("p") >= 1e-6)
    m = F.broadcast(modes.where(F.col("prior") >= 1e-6).select("k", "prior", F.posexplode(F.arrays_zip(F.col("mean").alias("m"), F.col("variance").alias("s"))).alias("i", "z")).select("k", "prior", "i", F.col("z.m").alias("m"), F.col("z.s").alias("s")))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    long = p.join(rows.select(group, "id", F.posexplode("x").alias("i", "x")), "id").join(m, ["k", "i"])
    d = (F.col("x") - F.col("m")) / F.sqrt("s")
    g = long.groupBy(group, "k", "i", "prior").agg(F.sum(F.col("p") * d).alias("u"), F.sum(F.col("p") * (d * d - 1)).alias("w")).join(size, group)
    parts = F.explode(F.array(F.struct(F.lit(0).alias("part"), (F.col("u") / (F.col("n") * F.sqrt("prior"))).alias("v")), F.struct(F.lit(1).alias("part"), (F.col("w") / (F.col("n") * F.sqrt(2 * F.col("prior")))).alias("v"))))
    out = g.select(group, "k", "i", parts.alias("t")).select(group, "k", "t.part", "i", "t.v")
    if improved:
        out = out.withColumn("v", F.signum("v") * F.sqrt(F.abs("v")))
        out = out.withColumn("v", F.col("v") / F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(group))), F.lit(1e-12)))
    return out


def project(rows: DataFrame, components: DataFrame, mean: list[float]) -> DataFrame:
    """(id, k, v): coordinates of x - mean along the components (k, u)."""
    centred = rows.select("id", F.zip_with("x", F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("x"))
    both = centred.join(F.broadcast(components), F.lit(True))
    return both.select("id", "k", F.aggregate(F.zip_with("x", "u", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("v"))


def losses(label: Column, score: Column) -> dict[str, Column]:
    """Losses of linear classifiers at a label of -1 or 1 and a score."""
    m = label * score
    return {"hinge": F.greatest(F.lit(0.0), 1 - m), "hinge2": F.greatest(F.lit(0.0), 1 - m) ** 2, "l1": F.abs(label - score), "l2": (label - score) ** 2, "logistic": F.log1p(F.exp(-m))}


def kernel_map(x: Column, n: int = 1, period: float = 0.5) -> list[Column]:
    """2 n + 1 features whose products come close to the chi2 kernel of non-negative values: the
    spectrum sech(pi w) sampled with the given period over ln x."""
    import math

    spectrum = lambda w: 1 / math.cosh(math.pi * w)
    log = F.ln(F.greatest(x, F.lit(1e-300)))
    out = [F.sqrt(x * (period * spectrum(0.0)))]
    for j in range(1, n + 1):
        amp = F.sqrt(x * (2 * period * spectrum(j * period)))
        out += [amp * F.cos(log * (j * period)), amp * F.sin(log * (j * period))]
    return [F.when(x > 0, c).otherwise(0.0) for c in out]

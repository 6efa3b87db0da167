"""Seeding of clusters, whole-number k-means, and its hierarchy.

Draws are fixed: the draw of a row is a number in (0, 1) made from its id and the number of the draw
by a linear congruence, so that results repeat and SQL can state them. Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut_lineage, em_step
from .metrics import squared

MODULUS = 2147483647


def draw(key: Column, n: int = 0) -> Column:
    """A number in (0, 1) for each key."""
    return (F.pmod((key * 7919 + (n * 104729 + 12345)) * 48271, F.lit(MODULUS)) + 1) / float(MODULUS + 1)


def random_centres(rows: DataFrame, k: int) -> DataFrame:
    """(k, c): the rows (id, x) with the k least draws, numbered from 0."""
    chosen = rows.select("id", "x", draw(F.col("id")).alias("u")).orderBy("u", "id").limit(k)
    return chosen.select((F.row_number().over(Window.orderBy("u", "id")) - 1).alias("k"), F.col("x").alias("c"))  # k rows


def spread_centres(rows: DataFrame, k: int) -> DataFrame:
    """(k, c) by k-means++: each further centre is drawn in proportion to the squared distance to the
    nearest centre so far. Least -ln(draw) / distance is such a draw and takes one pass; distances
    are kept between passes."""
    first = random_centres(rows, 1).first()
    spark = rows.sparkSession
    chosen = [] if first is None else [list(first.c)]
    away = rows.select("id", "x", F.lit(float("inf")).alias("d")) if chosen else rows
    while chosen and len(chosen) < k:
        last = F.array(*(F.lit(float(v)) for v in chosen[-1]))
        away = cut_lineage(away.select("id", "x", F.least("d", squared(F.col("x"), last)).alias("d")))
        race = -F.log(draw(F.col("id"), len(chosen))) / F.col("d")
        best = away.where("d > 0").orderBy(race, "id").first()
        if best is None:  # fewer different rows than centres
            break
        chosen.append(list(best.x))
    return spark.createDataFrame(list(enumerate(chosen)), "k int, c array<double>")


def modes_of(rows: DataFrame, centres: DataFrame, floor: float = 1e-4) -> DataFrame:
    """(k, mean, variance, prior) to start a mixture from: the rows nearest to each centre; a centre
    without rows is left out."""
    from .neighbors import nearest_centre

    at = nearest_centre(rows, centres).select("id", "k").join(rows.select("id", F.posexplode("x").alias("i", "v")), "id")
    n = F.count(F.lit(1))
    per = at.groupBy("k", "i").agg(F.avg("v").alias("m"), F.greatest(F.lit(floor), F.var_pop("v")).alias("s"), n.alias("n"))
    arr = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    total = rows.count()
    return per.groupBy("k").agg(arr.alias("a"), F.max("n").alias("n")).select("k", F.transform("a", lambda t: t["m"]).alias("mean"), F.transform("a", lambda t: t["s"]).alias("variance"), (F.col("n") / total).alias("prior"))


def random_modes(rows: DataFrame, k: int, floor: float = 1e-4) -> DataFrame:
    """Modes at k drawn rows, with the variance of all rows and equal priors."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    variance = rows.agg(F.array(*(F.greatest(F.lit(floor), F.var_pop(F.get("x", F.lit(i)))) for i in range(dims))).alias("variance"))
    return random_centres(rows, k).crossJoin(F.broadcast(variance)).select("k", F.col("c").alias("mean"), "variance", F.lit(1.0 / k).alias("prior"))  # one row of variances


def fit_mixture(rows: DataFrame, k: int, start: str = "random", rounds: int = 20) -> DataFrame:
    """Modes after rounds of em_step; start: "random" rows or "kmeans++" centres."""
    modes = random_modes(rows, k) if start == "random" else modes_of(rows, spread_centres(rows, k))
    for _ in range(rounds):
        modes = cut_lineage(em_step(rows, modes))
    return modes


def whole_assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (node, id, x: array<bigint>) with k and distance of the nearest centre (node, k, c) of their
    node; the least k of equal ones. centres: (children of all nodes), joined by node."""
    arrays = centres.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("cs"))
    d = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    best = F.array_min(F.transform("cs", lambda s: F.struct(d(s["c"]).alias("distance"), s["k"].alias("k"))))
    return rows.join(arrays, "node").select("node", "id", "x", best["k"].alias("k"), best["distance"].alias("distance"))


def whole_centres(assigned: DataFrame) -> DataFrame:
    """(node, k, c): means of the rows, divided as whole numbers (towards zero)."""
    per = assigned.select("node", "k", F.posexplode("x").alias("i", "v")).groupBy("node", "k", "i").agg((F.sum("v") / F.count(F.lit(1))).cast("bigint").alias("m"))
    return per.groupBy("node", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def whole_kmeans(rows: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(node, k, c): whole-number Lloyd in every node at once, from the k rows of a node with the least
    draws; a centre that loses its rows stays."""
    w = Window.partitionBy("node").orderBy("u", "id")
    tops = rows.select("node", "id", "x", draw(F.col("id")).alias("u")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    centres = cut_lineage(tops.select("node", (F.col("n") - 1).alias("k"), F.col("x").alias("c")))
    for _ in range(rounds):
        moved = whole_centres(whole_assign(rows, centres)).withColumnRenamed("c", "new")
        new = cut_lineage(centres.join(moved, ["node", "k"], "left").select("node", "k", F.coalesce("new", "c").alias("c"), (~F.col("new").eqNullSafe(F.col("c")) & F.col("new").isNotNull()).alias("moved")))
        centres = new.select("node", "k", "c")
        if new.where("moved").limit(1).count() == 0:
            break
    return centres


def hierarchy(rows: DataFrame, k: int, depth: int, rounds: int = 10) -> list[DataFrame]:
    """Centres (node, k, c) of each level over rows (id, x); the children of node n are n * k + 1 + (0 .. k - 1)."""
    at = rows.select(F.lit(0).cast("bigint").alias("node"), "id", "x")
    levels = []
    for _ in range(depth):
        centres = whole_kmeans(at, k, rounds)
        levels.append(centres)
        at = cut_lineage(descend(at, centres, k))
    return levels


def descend(at: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    return whole_assign(at, centres).select((F.col("node") * k + 1 + F.col("k")).alias("node"), "id", "x")


def push(rows: DataFrame, levels: list[DataFrame], k: int) -> DataFrame:
    """(id, path): the node that each row (id, x) reaches on every level."""
    at = rows.select(F.lit(0).cast("bigint").alias("node"), "id", "x", F.array().cast("array<bigint>").alias("path"))
    for centres in levels:
        step = whole_assign(at, centres).select("id", (F.col("node") * k + 1 + F.col("k")).alias("next"))
        at = at.join(step, "id").select(F.col("next").alias("node"), "id", "x", F.concat("path", F.array("next")).alias("path"))
    return at.select("id", "path")

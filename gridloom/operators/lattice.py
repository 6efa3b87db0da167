"""Generators of the lattice that offsets lie on.

Offsets (dx, dy) are spread over a map of cells by a Gaussian window. A candidate's energy is the sum of
the map over its multiples within the map's bounds, less a penalty for each empty one; the first generator has the
highest measure, the second one the highest over the lattice of both. Candidates are cells: each is
exploded into its multiples, which meet the map by an equi-join on cells, so that work grows with the
map (the offsets' range) and not with the offsets, which are summed before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut_lineage

#: Measures of at most this much count as none.
NONE = 1e-8


@dataclass(frozen=True)
class Options:
    """nearest, farthest: lengths of generators; angle: least between two; measure: f, g, precision, recall or value; beta: of f."""

    sigma: float = 3.0
    penalty: float = 1.0
    nearest: float = 5.0
    farthest: float = math.inf
    angle: float = math.pi / 16
    measure: str = "f"
    beta: float = 0.1


@dataclass(frozen=True)
class Map:
    """cells (x, y, e), bounds (least x, least y, largest x, largest y), penalty of an empty cell, and the sum of e."""

    cells: DataFrame
    bounds: tuple[int, int, int, int]
    penalty: float
    total: float


def density(offsets: DataFrame, o: Options = Options()) -> Map | None:  # noqa: B008
    """The map of offsets (dx, dy): each adds exp(-d^2 / (2 sigma)) to the cells up to ceil(2 sigma) beyond
    those around it. None without offsets."""
    n = cut_lineage(offsets.groupBy(F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")).agg(F.count(F.lit(1)).alias("n")))
    reach = math.ceil(2 * o.sigma)
    low = lambda c: F.floor(c) - reach
    high = lambda c: F.ceil(c) + reach
    b = n.agg(F.min(low("dx")), F.min(low("dy")), F.max(high("dx")), F.max(high("dy"))).first()
    if b[0] is None:
        return None
    sent = n.withColumn("x", F.explode(F.sequence(low("dx"), high("dx")))).withColumn("y", F.explode(F.sequence(low("dy"), high("dy"))))
    gap = (F.col("dx") - F.col("x")) ** 2 + (F.col("dy") - F.col("y")) ** 2
    cells = cut_lineage(sent.groupBy("x", "y").agg(F.sum(F.col("n") * F.exp(-gap / (2 * o.sigma))).alias("e")).where("e > 0"))
    s = cells.agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n")).first()
    return Map(cells, tuple(b), s.e / s.n * o.penalty, s.e)


def _steps(start: Column, step: Column, low: int, high: int) -> tuple[Column, Column]:
    """The least and largest k with low <= start + k * step <= high; nothing bounds k where step is 0."""
    a, b = F.try_divide(F.lit(low) - start, step), F.try_divide(F.lit(high) - start, step)
    inside = start.between(low, high)
    far = F.lit(1 << 40)
    return F.when(step == 0, F.when(inside, -far).otherwise(far)).otherwise(F.ceil(F.least(a, b))), F.when(step == 0, F.when(inside, far).otherwise(-far)).otherwise(F.floor(F.greatest(a, b)))


def _multiples(df: DataFrame, base: tuple[str, str], step: tuple[str, str], out: tuple[str, str], bounds: tuple[int, int, int, int]) -> DataFrame:
    """df with a row for each k such that base + k * step, as columns out, lies within the bounds."""
    (ax, bx), (ay, by) = (_steps(F.col(base[i]), F.col(step[i]), bounds[i], bounds[i + 2]) for i in (0, 1))
    low, high = F.greatest(ax, ay), F.least(bx, by)
    many = df.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    return many.select(*df.columns, *((F.col(base[i]) + F.col("_k") * F.col(step[i])).alias(out[i]) for i in (0, 1)))


def _measured(points: DataFrame, keys: list[str], m: Map, o: Options) -> DataFrame:
    """(keys, measure) of points (keys, zx, zy), the origin not counted."""
    met = points.where((F.col("zx") != 0) | (F.col("zy") != 0)).join(m.cells.select(F.col("x").alias("zx"), F.col("y").alias("zy"), "e"), ["zx", "zy"], "left")
    s = met.groupBy(*keys).agg(F.sum(F.coalesce("e", F.lit(-m.penalty))).alias("s"), F.count(F.lit(1)).alias("n"))
    p = F.when(F.col("s") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    r = F.greatest(F.col("s"), F.lit(0.0)) / m.total
    b = o.beta**2
    f = F.when((p < NONE) | (r < NONE), 0.0).otherwise((1 + b) * p * r / (b * p + r))
    value = {"f": f, "g": p * r, "precision": p, "recall": r, "value": F.col("s") / F.col("n")}[o.measure]
    return s.select(*keys, F.round(value, 12).alias("measure")).where("measure > 0")


def _cells(m: Map, spark, right: bool, o: Options) -> DataFrame:
    """(dx, dy): cells of the right half (x >= 0) or of the lower one (y >= 0) whose distance is in the range."""
    x0, y0, x1, y1 = m.bounds
    x0, y0 = (0, y0) if right else (x0, 0)
    width = max(x1 - x0 + 1, 0)
    all_ = spark.range(width * max(y1 - y0 + 1, 0)).select((F.col("id") % max(width, 1) + x0).alias("dx"), (F.floor(F.col("id") / max(width, 1)) + y0).alias("dy"))
    length = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    return all_.where((length >= o.nearest) & (length <= o.farthest) & (length > 0))


def first_generators(m: Map, spark, n: int = 1, o: Options = Options()) -> DataFrame:  # noqa: B008
    """(dx, dy, measure): the n candidates of the right half with the highest measure; of equal ones those that come first
    row by row."""
    c = _cells(m, spark, True, o).withColumn("o", F.lit(0).cast("long"))
    points = _multiples(c, ("o", "o"), ("dx", "dy"), ("zx", "zy"), m.bounds)
    return _measured(points, ["dx", "dy"], m, o).orderBy(F.col("measure").desc(), "dy", "dx").limit(n)


def second_generators(m: Map, firsts: DataFrame, o: Options = Options()) -> DataFrame:  # noqa: B008
    """(gx, gy, dx, dy, measure): for each first generator (dx, dy) the best second one, at least the angle away from it."""
    g = firsts.select(F.col("dx").cast("long").alias("gx"), F.col("dy").cast("long").alias("gy"))
    turn = F.abs(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")) - F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double")))
    turn = F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn)
    turn = F.when(turn > math.pi / 2, math.pi - turn).otherwise(turn)
    both = _cells(m, firsts.sparkSession, False, o).join(F.broadcast(g), turn >= o.angle)  # a few first generators
    lines = _multiples(both.withColumn("o", F.lit(0).cast("long")), ("o", "o"), ("gx", "gy"), ("ux", "uy"), m.bounds)
    points = _multiples(lines, ("ux", "uy"), ("dx", "dy"), ("zx", "zy"), m.bounds)
    found = _measured(points, ["gx", "gy", "dx", "dy"], m, o)
    order = Window.partitionBy("gx", "gy").orderBy(F.col("measure").desc(), "dy", "dx")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def generators(offsets: DataFrame, n: int = 1, o: Options = Options()) -> tuple[tuple[int, int], tuple[int, int], float] | None:  # noqa: B008
    """The two generators (x, y) whose lattice has the highest measure, with first ones among the n best, and that
    measure; None if there are none."""
    m = density(offsets, o)
    if m is None:
        return None
    firsts = cut_lineage(first_generators(m, offsets.sparkSession, n, o))
    best = second_generators(m, firsts, o).join(firsts.select(F.col("dx").alias("gx"), F.col("dy").alias("gy"), F.col("measure").alias("first")), ["gx", "gy"])
    r = best.orderBy(F.col("measure").desc(), F.col("first").desc(), "gy", "gx").first()
    return ((r.gx, r.gy), (r.dx, r.dy), r.measure) if r else None

"""Randomised search for nearest patches: a field that gets better round by round.

The field is a table of the best target place so far of each place, (y, x, ty, tx, dist). A round first
propagates: a place tries the shifted offsets of its neighbours above and to the left, in the next round of those
below and to the right. Then it tries places drawn around its own target, in windows that halve. Candidates
are projections of the field; their distances take two joins with the tables of patches by place, and the best
one stays by a minimum, ties by (ty, tx). All places move at once, so a good offset travels one place a round, and the result
doesn't depend on how rows are laid out. Draws are hashes of seed, round and place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut_lineage
from .forest import draw
from .patchfield import distance, patches


@dataclass(frozen=True)
class Options:
    """patch: its side; window: the first window's reach (None: the whole target); least_gap: a target must be at least so far
    from the place itself in y or x (searches within one grid)."""

    patch: int = 3
    window: int | None = None
    least_gap: int = 0
    seed: int = 0


def _valid(h: int, w: int, o: Options) -> Column:
    """Whether the target place (ty, tx) has a whole patch in a grid of h x w, far enough from (y, x)."""
    inside = (F.col("ty") >= 0) & (F.col("ty") <= h - o.patch) & (F.col("tx") >= 0) & (F.col("tx") <= w - o.patch)
    return inside & (F.greatest(F.abs(F.col("ty") - F.col("y")), F.abs(F.col("tx") - F.col("x"))) >= o.least_gap)


def started(places: DataFrame, h: int, w: int, o: Options) -> DataFrame:
    """(y, x, ty, tx): a drawn target for each place (y, x); where that is too near, one on the other side of the grid."""
    rows, cols = h - o.patch + 1, w - o.patch + 1
    at = lambda n, axis: F.least(F.floor(draw(o.seed, -1, axis, F.col("y"), F.col("x")) * n), F.lit(n - 1)).cast("int")
    out = places.select("y", "x", at(rows, 0).alias("ty"), at(cols, 1).alias("tx"))
    near = ~_valid(h, w, o)
    far = lambda c, n: F.pmod(F.col(c) + n // 2, F.lit(n)).cast("int")
    return out.select("y", "x", F.when(near, far("y", rows)).otherwise(F.col("ty")).alias("ty"), F.when(near, far("x", cols)).otherwise(F.col("tx")).alias("tx"))


def _better(field: DataFrame | None, tries: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The field with those of the tries (y, x, ty, tx) that are better."""
    asked = tries.distinct().join(source, ["y", "x"]).join(target, ["ty", "tx"])
    found = asked.select("y", "x", F.round(distance(F.col("patch"), F.col("tp")), 9).alias("dist"), "ty", "tx")
    if field is not None:
        found = found.unionByName(field)
    best = found.groupBy("y", "x").agg(F.min(F.struct("dist", "ty", "tx")).alias("b"))
    return cut_lineage(best.select("y", "x", "b.ty", "b.tx", "b.dist"))


def _neighbours(field: DataFrame, step: int) -> DataFrame:
    """What the two neighbours before (step 1) or behind (-1) of each place propose to it."""
    to = F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), (F.col("ty") + a).alias("ty"), (F.col("tx") + b).alias("tx")) for a, b in ((step, 0), (0, step))))
    return field.select(F.explode(to).alias("s")).select("s.y", "s.x", "s.ty", "s.tx")


def _drawn(field: DataFrame, turn: int, window: int, seed: int) -> DataFrame:
    """Places around each target, one for each window from ``window`` on, halved down to 1."""
    reach, k, tries = window, 0, []
    while reach >= 1:
        off = lambda axis, k=k, reach=reach: F.round((2 * draw(seed, turn, k, axis, F.col("y"), F.col("x")) - 1) * reach).cast("int")
        tries.append(F.struct("y", "x", (F.col("ty") + off(0)).alias("ty"), (F.col("tx") + off(1)).alias("tx")))
        reach, k = reach // 2, k + 1
    return field.select(F.explode(F.array(*tries)).alias("s")).select("s.y", "s.x", "s.ty", "s.tx")


def search(source: DataFrame, target: DataFrame, h: int, w: int, rounds: int = 5, o: Options = Options(), start: DataFrame | None = None) -> tuple[DataFrame, list[float]]:  # noqa: B008
    """The field (y, x, ty, tx, dist) of the source's patches in a target of h x w cells (both r, c, v), and the mean
    distance at the start and after each round. start: a field (y, x, ty, tx) to begin with."""
    s = cut_lineage(patches(source, o.patch))
    t = cut_lineage(patches(target, o.patch).select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("patch").alias("tp")))
    mean = lambda f: f.agg(F.avg("dist")).first()[0]
    begin = start.select("y", "x", "ty", "tx").where(_valid(h, w, o)) if start is not None else started(s.select("y", "x"), h, w, o)
    field = _better(None, begin, s, t)
    means = [mean(field)]
    for turn in range(rounds):
        field = _better(field, _neighbours(field, 1 if turn % 2 == 0 else -1).where(_valid(h, w, o)), s, t)
        field = _better(field, _drawn(field, turn, o.window or max(h, w), o.seed).where(_valid(h, w, o)), s, t)
        means.append(mean(field))
    return field, means

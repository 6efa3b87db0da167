"""Least squares over sparse tables (row, col, value), and the combination of an image with gradients.

A system is brought to its normal equations by one join on the rows; these are solved by conjugate
gradients with the diagonal as preconditioner. A round is a join of the matrix with the direction, a sum by row,
and a sum over all rows for the step; the residual after the step follows from the same sums, so that each round
reads the state once. States are checkpointed: a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut_lineage

#: Rounds without a smaller residual after which the solution is taken as it is.
PATIENCE = 50


def normal_equations(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix (i, j, v) and the right side (i, v) of A'A x = A'b, of A (row, col, value) and b (row, value)."""
    a = cut_lineage(a.groupBy("row", "col").agg(F.sum("value").alias("value")))
    other = a.select("row", F.col("col").alias("j"), F.col("value").alias("w"))
    n = a.join(other, "row").groupBy(F.col("col").alias("i"), "j").agg(F.sum(F.col("value") * F.col("w")).alias("v"))
    right = a.join(b.select("row", F.col("value").alias("w")), "row").groupBy(F.col("col").alias("i")).agg(F.sum(F.col("value") * F.col("w")).alias("v"))
    return n, right


def conjugate_gradients(n: DataFrame, right: DataFrame, tolerance: float = 1e-8, rounds: int | None = None) -> tuple[DataFrame, list[float]]:
    """x (i, v) of the symmetric positive system n (i, j, v) with the right side (i, v), and the residuals' norms over
    that of the right side, the first one 1. It ends at the tolerance, after so many rounds, or when the
    residual no longer falls. Unknowns are the rows of n; where the right side is missing it is 0."""
    n = cut_lineage(n.where("v <> 0"))
    diagonal = n.where("i = j").select("i", F.col("v").alias("d"))
    state = diagonal.join(right.select("i", F.col("v").alias("r")), "i", "left").fillna(0.0, ["r"])
    state = cut_lineage(state.select("i", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p")))
    first = state.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz")).first()
    if not first.rr:
        return state.select("i", F.col("x").alias("v")), [0.0]
    rz, norms, best = first.rz, [1.0], 0
    while norms[-1] > tolerance and (rounds is None or len(norms) <= rounds) and len(norms) - 1 - best < PATIENCE:
        q = n.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("q"))
        both = cut_lineage(state.join(q, "i", "left").fillna(0.0, ["q"]))
        r, q, d = F.col("r"), F.col("q"), F.col("d")
        s = both.agg(F.sum(F.col("p") * q).alias("pq"), F.sum(r * r).alias("rr"), F.sum(r * q).alias("rq"), F.sum(q * q).alias("qq"), F.sum(r * q / d).alias("rqd"), F.sum(q * q / d).alias("qqd"), F.sum(r * r / d).alias("rrd")).first()
        if s.pq <= 0:
            break
        step = rz / s.pq
        after = s.rrd - 2 * step * s.rqd + step * step * s.qqd
        norms.append((max(s.rr - 2 * step * s.rq + step * step * s.qq, 0.0) / first.rr) ** 0.5)
        state = both.select("i", "d", (F.col("x") + step * F.col("p")).alias("x"), (r - step * q).alias("r"), ((r - step * q) / d + max(after, 0.0) / rz * F.col("p")).alias("p"))
        if norms[-1] < min(norms[:-1]):
            best = len(norms) - 1
        rz = max(after, 0.0)
        if rz == 0:
            break
    return state.select("i", F.col("x").alias("v")), norms


def blend_system(cells: DataFrame, h: int, w: int, weight: float) -> tuple[DataFrame, DataFrame]:
    """A (row, col, value) and b (row, value) of an image that is near v and has differences near dx and dy. cells
    (r, c, v, m, dx, dy), numbered column by column: where the mask m is 1 a difference to the next column or row
    counts weight and the value 1; towards a mask of 0 both count up to 101 times that. Differences over 100 count as none."""
    n = h * w
    me = (F.col("c") * h + F.col("r")).cast("long")
    k = 1 + 100 * (1 - F.col("m"))
    calm = lambda c: F.when(F.abs(c) > 100, 0.0).otherwise(F.col(c))
    entry = lambda row, col, value: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), value.alias("value"))
    one = cells.select("r", "c", "v", me.alias("me"), (weight * k).alias("g"), k.alias("k"), calm("dx").alias("dx"), calm("dy").alias("dy"))
    here = F.col("me")
    right, below = F.col("c") < w - 1, F.col("r") < h - 1
    inside = F.array(entry(2 * n + here, here, F.col("k")))
    along = F.when(right, F.array(entry(here, here, F.col("g")), entry(here, here + h, -F.col("g")))).otherwise(F.array().cast("array<struct<row:bigint,col:bigint,value:double>>"))
    down = F.when(below, F.array(entry(n + here, here, F.col("g")), entry(n + here, here + 1, -F.col("g")))).otherwise(F.array().cast("array<struct<row:bigint,col:bigint,value:double>>"))
    a = one.select(F.explode(F.concat(inside, along, down)).alias("e")).select("e.row", "e.col", "e.value").where("value <> 0")
    pair = lambda row, value: F.struct(row.cast("long").alias("row"), value.alias("value"))
    b = one.select(F.explode(F.array(pair(here, F.col("g") * F.col("dx")), pair(n + here, F.col("g") * F.col("dy")), pair(2 * n + here, F.col("k") * F.col("v")))).alias("e"))
    return a, b.select("e.row", "e.value")


def poisson(cells: DataFrame, h: int, w: int, weight: float, tolerance: float = 1e-8, rounds: int | None = None) -> tuple[DataFrame, list[float]]:
    """(r, c, v): the image of least squares of :func:`blend_system`, and the residuals by round."""
    x, norms = conjugate_gradients(*normal_equations(*blend_system(cells, h, w, weight)), tolerance, rounds)
    return x.select((F.col("i") % h).cast("int").alias("r"), F.floor(F.col("i") / h).cast("int").alias("c"), "v"), norms

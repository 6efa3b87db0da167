"""Keypoint frames, skew matrices, boxes given by others, lists of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def oriented_ellipse(f: Sequence[Column]) -> list[Column]:
    """(x, y, a11, a21, a12, a22) of a frame of 2 (point), 3 (disc), 4 (oriented disc), 5 (ellipse) or 6 numbers."""
    zero = F.lit(0.0)
    if len(f) == 2:
        return [*f, zero, zero, zero, zero]
    if len(f) == 3:
        return [f[0], f[1], f[2], zero, zero, f[2]]
    if len(f) == 4:
        c, s = f[2] * F.cos(f[3]), f[2] * F.sin(f[3])
        return [f[0], f[1], c, s, -s, c]
    if len(f) == 5:  # lower triangle that makes the covariance (s11, s12, s22)
        a = F.sqrt(f[2])
        b = f[3] / F.greatest(a, F.lit(1e-18))
        return [f[0], f[1], a, b, zero, F.sqrt(F.greatest(f[4] - b * b, zero))]
    return list(f)


def transposed_region(f: Sequence[Column]) -> list[Column]:
    """A region (x, y, s11, s12, s22) with its axes exchanged."""
    return [f[1], f[0], f[4], f[3], f[2]]


def skew(x: Column, y: Column, z: Column) -> list[Column]:
    """The matrix that takes v to the cross product (x, y, z) * v, rows one after another."""
    o = F.lit(0.0)
    return [o, -z, y, z, o, -x, -y, x, o]


def unskew(m: Sequence[Column]) -> list[Column]:
    return [m[7], m[2], m[3]]


def affine_derivatives(x: Column, y: Column) -> tuple[list[Column], list[Column]]:
    """Derivatives of both outputs of an affine map by (a11, a21, a12, a22, t1, t2)."""
    o, one = F.lit(0.0), F.lit(1.0)
    return [x, o, y, o, one, o], [o, x, o, y, o, one]


def relative(box: Sequence[Column], ref: Sequence[Column]) -> list[Column]:
    """A box (x, y, w, h) in units of the box ref; a side of ref of 0 counts as 1."""
    w, h = (F.when(s == 0, 1.0).otherwise(s) for s in ref[2:])
    return [(box[0] - ref[0]) / w, (box[1] - ref[1]) / h, box[2] / w, box[3] / h]


def absolute(box: Sequence[Column], ref: Sequence[Column]) -> list[Column]:
    """The inverse of :func:`relative`."""
    w, h = (F.when(s == 0, 1.0).otherwise(s) for s in ref[2:])
    return [box[0] * w + ref[0], box[1] * h + ref[1], box[2] * w, box[3] * h]


def extent(box: Sequence[Column], degrees: Column, ellipse: bool = False) -> list[Column]:
    """The upright box around a box, or the ellipse in it, turned about its centre."""
    x, y, w, h = box
    a = F.radians(degrees)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    if ellipse:
        half = [F.sqrt((w * c) ** 2 + (h * s) ** 2) / 2, F.sqrt((w * s) ** 2 + (h * c) ** 2) / 2]
    else:
        half = [(w * c + h * s) / 2, (w * s + h * c) / 2]
    turned = [x + w / 2 - half[0], y + h / 2 - half[1], 2 * half[0], 2 * half[1]]
    return [F.when(degrees == 0, o).otherwise(t) for o, t in zip(box, turned, strict=True)]


def strongest(points: DataFrame, radii: tuple[float, float], threshold: float | None = None, most: int = 0, ties: bool = False) -> DataFrame:
    """Points (id, y, x, v) without a stronger one within the radii along both axes; above threshold, and
    the strongest ``most`` of them. ties: equal ones drop each other. Points of a place count as its best value, and
    of a cell, all of whose places are within the radii of each other, only the best places can stay: these few
    meet the places of the cells around them. No pair of points is made."""
    p = points if threshold is None else points.where(F.col("v") > threshold)
    side = [max(r, 1e-9) / 1.5 for r in radii]
    finite = lambda c: F.coalesce(F.col(c) - F.col(c) == 0, F.lit(False))
    met = finite("y") & finite("x") & F.col("v").isNotNull() & (F.col("id").isNotNull() if ties else F.lit(True))
    cell = lambda c, r: F.floor(F.col(c) / r)
    # lone: one row alone has the best value of its place
    best = p.where(met).groupBy("y", "x", "v").agg((F.min("id") == F.max("id")).alias("lone")).groupBy("y", "x").agg(F.max(F.struct("v", "lone")).alias("b"))
    at = best.select("y", "x", "b.v", "b.lone", cell("y", side[0]).alias("cy"), cell("x", side[1]).alias("cx"))
    # a radius of 0 leaves each place by itself
    own = ["cy", "cx", *(["y"] if not radii[0] else []), *(["x"] if not radii[1] else [])]
    head = at.join(at.groupBy(*own).agg(F.max("v").alias("v")), [*own, "v"])
    around = F.sequence(F.lit(-2), F.lit(2))
    near = head.select("y", "x", "v", "cx", F.explode(F.transform(around, lambda i: F.col("cy") + i)).alias("cy")).select("y", "x", "v", "cy", F.explode(F.transform(around, lambda i: F.col("cx") + i)).alias("cx"))
    o = at.select(*(F.col(c).alias(f"_{c}") for c in at.columns))
    other = (F.col("_y") != F.col("y")) | (F.col("_x") != F.col("x"))
    better = (F.col("_v") >= F.col("v")) & other if ties else F.col("_v") > F.col("v")
    close = (F.abs(F.col("_y") - F.col("y")) <= radii[0]) & (F.abs(F.col("_x") - F.col("x")) <= radii[1])
    beaten = near.join(o, (F.col("cy") == F.col("_cy")) & (F.col("cx") == F.col("_cx")) & close & better, "left_semi").select("y", "x").distinct()
    stay = (head.where("lone") if ties else head).join(beaten, ["y", "x"], "left_anti").select(*(F.col(c).alias(f"_{c}") for c in "yxv"))
    kept = p.where(met).join(stay, (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")) & (F.col("v") == F.col("_v")), "left_semi").unionByName(p.where(~met))
    return kept.orderBy(F.desc("v"), "id").limit(most) if most else kept


def windowed(points: DataFrame, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """Points in the window, its borders included."""
    return points.where(F.col("y").between(start[0], end[0]) & F.col("x").between(start[1], end[1]))


def folds(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with a fold 0 .. n - 1, of a hash of the key: the same for the same key, without a shuffle."""
    return df.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)).cast("int"))


def shuffled(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows in an order that hashes of the key give, the first ``most`` of them."""
    out = df.orderBy(F.crc32(F.col(key).cast("string").cast("binary")), key)
    return out.limit(most) if most is not None else out


def every(df: DataFrame, row: str, share: int) -> DataFrame:
    """Each share-th row by its number."""
    return df.where(F.pmod(F.col(row), F.lit(share)) == 0)


def mode_of(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mode): the most frequent value; the least of equal ones."""
    n = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by(F.col(value), F.struct((-F.col("n")).alias("a"), F.col(value))).alias("mode"))


def matched_curve(found: DataFrame, truths: int, images: int, roc: bool = True) -> DataFrame:
    """(id, score, x, y) of detections (id, score, hit: 1, 0 or -1 to leave out), best first: false hits an
    image and share found, or, without roc, share found and precision."""
    from ..operators.ranked import running

    used = found.where("hit <> -1").select("id", "score", "hit")
    r = running(used, "score", "id", {"ntp": (F.col("hit") == 1).cast("long"), "nfp": (F.col("hit") != 1).cast("long")})
    x, y = (F.col("nfp") / images, F.col("ntp") / max(truths, 1)) if roc else (F.col("ntp") / max(truths, 1), F.col("ntp") / (F.col("nfp") + F.col("ntp")))
    return r.select("id", "score", x.alias("x"), y.alias("y"))

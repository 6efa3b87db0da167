"""Operators on grids stored as rows (r, c, v): windows along rows and columns.

Windows are partitioned by the line they run along, so a grid of any height spreads over all
tasks; separable filters run as two passes. Borders are named at each operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(along: str) -> tuple[str, str]:
    return ("r", "c") if along == "c" else ("c", "r")


def running_max(df: DataFrame, along: str = "c", value: str = "v") -> DataFrame:
    fixed, order = _line(along)
    w = Window.partitionBy(fixed).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("out", F.max(value).over(w))


def gradient(df: DataFrame) -> DataFrame:
    """gx, gy: central differences, one-sided on the border."""
    out = df
    for name, along in (("gx", "c"), ("gy", "r")):
        fixed, order = _line(along)
        w = Window.partitionBy(fixed).orderBy(order)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        step = (after.isNotNull().cast("int") + before.isNotNull().cast("int")).cast("double")
        out = out.withColumn(name, (F.coalesce(after, F.col("v")) - F.coalesce(before, F.col("v"))) / F.nullif(step, F.lit(0.0)))
    return out


def forward_difference(df: DataFrame) -> DataFrame:
    """gx, gy: next minus this, 0 on the last line."""
    out = df
    for name, along in (("gx", "c"), ("gy", "r")):
        fixed, order = _line(along)
        out = out.withColumn(name, F.coalesce(F.lead("v").over(Window.partitionBy(fixed).orderBy(order)) - F.col("v"), F.lit(0.0)))
    return out


def _pass(df: DataFrame, along: str, radius: int, agg) -> DataFrame:
    fixed, order = _line(along)
    w = Window.partitionBy(fixed).orderBy(order).rowsBetween(-radius, radius)
    return df.select("r", "c", agg(F.col("v"), w).alias("v"))


def mirrored_filter(df: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Separable stencil with the given odd number of weights over whole lines; cells outside mirror those
    inside, the border cell first. A line is an array, a row of its own."""
    radius, out = len(weights) // 2, df.select("r", "c", "v")
    for along in ("c", "r"):
        fixed, order = _line(along)
        lines = out.groupBy(fixed).agg(F.array_sort(F.collect_list(F.struct(order, "v"))).alias("a"))

        def at(i: Column) -> Column:
            n = F.size("a")
            j = F.pmod(i, 2 * n)
            return F.get("a", F.when(j < n, j).otherwise(2 * n - 1 - j))["v"]

        value = lambda i: reduce(lambda s, k: s + at(i + (k - radius)) * weights[k], range(1, len(weights)), at(i - radius) * weights[0])
        made = F.transform("a", _numbered(order, value))
        out = lines.select(fixed, F.explode(made).alias("s")).select(fixed, F.col(f"s.{order}").alias(order), "s.v").select("r", "c", "v")
    return out


def _numbered(order: str, value):
    return lambda s, i: F.struct(s[order].alias(order), value(i).alias("v"))


def sampled(df: DataFrame, h: int, w: int, step: int) -> DataFrame:
    """Every step-th row and column, from the middle of the first ``step`` on."""
    first = step // 2
    keep = (F.pmod(F.col("r") - first, F.lit(step)) == 0) & (F.pmod(F.col("c") - first, F.lit(step)) == 0) & (F.col("r") < h // step * step) & (F.col("c") < w // step * step)
    return df.where(keep & (F.col("r") >= first) & (F.col("c") >= first)).select(((F.col("r") - first) / step).cast("int").alias("r"), ((F.col("c") - first) / step).cast("int").alias("c"), "v")


def box_filter(df: DataFrame, radius: int) -> DataFrame:
    """Mean over the (2 radius + 1) square, with mirrored borders."""
    return mirrored_filter(df, [1 / (2 * radius + 1)] * (2 * radius + 1))


def window_mean(df: DataFrame, radius: int) -> DataFrame:
    """Mean over the (2 radius + 1) square, over the cells there are."""
    one = _pass(df, "c", radius, lambda v, w: F.avg(v).over(w))
    return _pass(one, "r", radius, lambda v, w: F.avg(v).over(w))


def max_filter(df: DataFrame, radius: int) -> DataFrame:
    one = _pass(df, "c", radius, lambda v, w: F.max(v).over(w))
    return _pass(one, "r", radius, lambda v, w: F.max(v).over(w))


def weighted_filter(df: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Separable stencil with the given odd number of weights; cells outside take the border cell's value."""
    radius = len(weights) // 2
    out = df.select("r", "c", "v")
    for along in ("c", "r"):
        fixed, order = _line(along)
        w = Window.partitionBy(fixed).orderBy(order)
        ends = Window.partitionBy(fixed).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        value: Column = F.lit(0.0)
        for k, weight in enumerate(weights):
            step = k - radius
            cell = F.col("v") if step == 0 else F.coalesce(F.lead("v", step).over(w), F.last("v").over(ends)) if step > 0 else F.coalesce(F.lag("v", -step).over(w), F.first("v").over(ends))
            value = value + cell * weight
        out = out.select("r", "c", value.alias("v"))
    return out


def triangle_filter(df: DataFrame, radius: float) -> DataFrame:
    """Weights that fall linearly to 0 at radius + 1, with mirrored borders; up to a radius of 1 three weights 1, p, 1
    with p = 12 / radius / (radius + 2) - 2."""
    if radius == 0:
        return df.select("r", "c", "v")
    if radius <= 1:
        p = 12 / radius / (radius + 2) - 2
        return mirrored_filter(df, [x / (2 + p) for x in (1, p, 1)])
    radius = round(radius)
    total = (radius + 1) ** 2
    return mirrored_filter(df, [(radius + 1 - abs(k)) / total for k in range(-radius, radius + 1)])


def gaussian_weights(sigma: float, radius: int | None = None) -> list[float]:
    import math

    radius = radius or math.ceil(3 * sigma)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def median_filter(df: DataFrame, radius: int, along: str = "c") -> DataFrame:
    """Running median along a line, over the cells there are."""
    return _pass(df, along, radius, lambda v, w: F.percentile(v, F.lit(0.5)).over(w))


def mode_filter(df: DataFrame, radius: int, along: str = "c") -> DataFrame:
    """Most frequent value along a line, the least of equally frequent ones."""
    fixed, order = _line(along)
    w = Window.partitionBy(fixed).orderBy(order).rowsBetween(-radius, radius)
    near = df.select("r", "c", F.array_sort(F.collect_list("v").over(w)).alias("a"))
    counts = F.transform(F.array_distinct("a"), lambda x: F.struct((-F.size(F.filter(F.col("a"), lambda y: y == x))).alias("n"), x.alias("x")))
    return near.select("r", "c", F.array_min(counts)["x"].alias("v"))


def integral(df: DataFrame) -> DataFrame:
    """Sum of all cells up and left of each cell, itself included: two running sums."""
    across = Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("r", "c", F.sum("v").over(across).alias("v")).select("r", "c", F.sum("v").over(down).alias("v"))


def integral_histogram(df: DataFrame, labels: Sequence[int]) -> DataFrame:
    """(r, c, lbl, n): cells of each label up and left of each cell; label 0 counts nowhere. df: (r, c, lbl)."""
    hot = df.select("r", "c", F.explode(F.array(*(F.struct(F.lit(k).alias("lbl"), (F.col("lbl") == k).cast("long").alias("n")) for k in labels if k))).alias("s")).select("r", "c", "s.lbl", "s.n")
    across = Window.partitionBy("lbl", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("lbl", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return hot.withColumn("n", F.sum("n").over(across)).withColumn("n", F.sum("n").over(down))


def sample_histogram(table: DataFrame, rects: DataFrame) -> DataFrame:
    """(id, lbl, n): counts in rectangles (id, r0, c0, r1, c1), ends included, from four corners of the table."""
    corner = F.explode(F.array(*(F.struct(F.col(r).alias("r") if not s else (F.col(r) - 1).alias("r"), (F.col(c) - t).alias("c"), F.lit(sign).alias("sign")) for r, s, c, t, sign in (("r1", 0, "c1", 0, 1), ("r0", 1, "c1", 0, -1), ("r1", 0, "c0", 1, -1), ("r0", 1, "c0", 1, 1))))).alias("k")
    four = rects.select("id", corner).select("id", F.col("k.r").cast("int").alias("r"), F.col("k.c").cast("int").alias("c"), "k.sign")
    return four.join(table, ["r", "c"]).groupBy("id", "lbl").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))


def neighbours(df: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """df with n_<k>: the cell steps[k] = (dr, dc) away, null outside: one explode and one grouped join back."""
    arr = F.array(*(F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(k).alias("k")) for k, (dr, dc) in enumerate(steps)))
    sent = df.select(F.explode(arr).alias("t"), F.col("v").alias("nv")).select("t.r", "t.c", "t.k", "nv")
    wide = sent.groupBy("r", "c").agg(*(F.max(F.when(F.col("k") == k, F.col("nv"))).alias(f"n_{k}") for k in range(len(steps))))
    return df.join(wide, ["r", "c"], "left")


EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def local_maxima(df: DataFrame, threshold: float = float("-inf")) -> DataFrame:
    """Cells above all eight neighbours and at least threshold; the border is left out."""
    keep = F.col("v") >= threshold
    for k in range(8):
        keep = keep & F.col(f"n_{k}").isNotNull() & (F.col("v") > F.col(f"n_{k}"))
    return neighbours(df, EIGHT).where(keep).select("r", "c", "v")


def binary_patterns(df: DataFrame) -> DataFrame:
    """(r, c, bin): local binary pattern of inner cells. Bits run around the cell from the right,
    downwards, set where the neighbour is larger. 56 uniform patterns by length and start, then
    all alike, then the rest."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    n = neighbours(df, around)
    inner = F.lit(True)
    code = F.lit(0)
    for k in range(8):
        inner = inner & F.col(f"n_{k}").isNotNull()
        code = code + F.when(F.col(f"n_{k}") > F.col("v"), 1 << k).otherwise(0)
    table = F.array(*(F.lit(pattern_bin(b)) for b in range(256)))
    return n.where(inner).select("r", "c", F.get(table, code).alias("bin"))


def pattern_bin(code: int) -> int:
    """0 to 55: uniform patterns (length of the run 1 to 7, then its start); 56: all or none; 57: others."""
    bits = [(code >> k) & 1 for k in range(8)]
    turns = [k for k in range(8) if bits[k] and not bits[k - 1]]
    if code in (0, 255):
        return 56
    return (sum(bits) - 1) * 8 + turns[0] if len(turns) == 1 else 57


def downsample(df: DataFrame) -> DataFrame:
    """Every other row and column."""
    return df.where((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0)).select((F.col("r") / 2).cast("int").alias("r"), (F.col("c") / 2).cast("int").alias("c"), "v")


def squared_distance_transform(df: DataFrame, coeff: float = 1.0, reach: int | None = None) -> DataFrame:
    """min over cells of v + coeff * squared distance: columns, then rows, each along its line.

    Lines are joined with themselves by line number; a line's length bounds the work per line.
    """
    out = df.select("r", "c", "v")
    for along in ("r", "c"):
        fixed, order = _line(along)
        other = out.select(F.col(fixed), F.col(order).alias("o2"), F.col("v").alias("v2"))
        near = F.lit(True) if reach is None else F.abs(F.col(order) - F.col("o2")) <= reach
        d = (F.col(order) - F.col("o2")) * (F.col(order) - F.col("o2")) * coeff + F.col("v2")
        out = out.join(other, fixed).where(near).groupBy("r", "c").agg(F.min(d).alias("v"))
    return out


def segment_mean(df: DataFrame, label: str) -> DataFrame:
    """df with out: the mean of v over the cells of the same label."""
    mean = df.groupBy(label).agg(F.avg("v").alias("out"))
    return df.join(mean, label)


def cropped(df: DataFrame, r0: int, r1: int, c0: int, c1: int, fill: float = 0.0) -> DataFrame:
    """The rectangle, ends included, from (0, 0); cells that df lacks hold fill."""
    width = c1 - c0 + 1
    full = df.sparkSession.range((r1 - r0 + 1) * width).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    inside = df.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).select((F.col("r") - r0).cast("int").alias("r"), (F.col("c") - c0).cast("int").alias("c"), "v")
    return full.join(inside, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(fill)).alias("v"))


def column_major(r: Column, c: Column, rows: int) -> Column:
    """1-based index of the 0-based cell, columns first."""
    return r + c * rows + 1

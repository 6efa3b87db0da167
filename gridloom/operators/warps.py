"""Padding, resampling, warps, stencils and blocks of grids (r, c, v) of h rows and w columns from 0.

Each output cell asks for the cells that it needs, by equality on (r, c): one shuffle of the grid a
step, whatever the warp. A stencil sends each cell to the outputs that use it, whose sums are partial
before they move.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lattice(df: DataFrame, h: int, w: int) -> DataFrame:
    """(r, c) of all cells."""
    return df.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c"))


def source_index(i: Column, n: int, mode: str) -> Column:
    """The index from 0 to n - 1 that stands for i outside of them; with "constant" i itself."""
    if mode == "replicate":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if mode == "symmetric":  # the border cell counts twice
        j = F.pmod(i, F.lit(2 * n))
        return F.when(j < n, j).otherwise(2 * n - 1 - j)
    if mode == "circular":
        return F.pmod(i, F.lit(n))
    return i


def looked_up(at: DataFrame, df: DataFrame, fill: float | None = None) -> DataFrame:
    """at (r, c, sr, sc) with the value of cell (sr, sc)."""
    found = at.join(df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "v"), ["sr", "sc"], "left")
    return found.select("r", "c", (F.coalesce("v", F.lit(fill)) if fill is not None else F.col("v")).alias("v"))


def padded(df: DataFrame, h: int, w: int, pad: tuple[int, int, int, int], mode: str = "constant", value: float = 0.0) -> DataFrame:
    """pad: cells above, below, left and right; mode: constant, replicate, symmetric or circular."""
    top, bottom, left, right = pad
    at = lattice(df, h + top + bottom, w + left + right)
    return looked_up(at.select("r", "c", source_index(F.col("r") - top, h, mode).alias("sr"), source_index(F.col("c") - left, w, mode).alias("sc")), df, value)


def to_size(df: DataFrame, h: int, w: int, h2: int, w2: int, value: float = 0.0) -> DataFrame:
    """The middle h2 by w2 cells, or df in the middle of that size; of an odd difference the larger half
    goes before the first cell that is kept."""
    dr, dc = -((h2 - h) // 2), -((w2 - w) // 2)
    return looked_up(lattice(df, h2, w2).select("r", "c", (F.col("r") + dr).alias("sr"), (F.col("c") + dc).alias("sc")), df, value)


def _weights(n: int, m: int) -> list[tuple[int, int, float]]:
    """(output, input, weight) to take n cells to m: shares of the overlap downwards, linear upwards."""
    out = []
    for i in range(m):
        if m < n:
            lo, hi = i * n / m, (i + 1) * n / m
            out += [(i, j, (min(hi, j + 1) - max(lo, j)) * m / n) for j in range(int(lo), min(n, math.ceil(hi - 1e-12)))]
        else:
            s = (i + 0.5) * n / m - 0.5
            j = math.floor(s)
            for k, x in ((j, 1 - (s - j)), (j + 1, s - j)):
                if x > 0:
                    out.append((i, min(max(k, 0), n - 1), x))
    return out


def resampled(df: DataFrame, h: int, w: int, h2: int, w2: int) -> DataFrame:
    """df with h2 rows and w2 columns. Tables of weights have a few rows for each line."""
    spark = df.sparkSession
    rows = spark.createDataFrame(_weights(h, h2), "r2 int, r int, a double")
    cols = spark.createDataFrame(_weights(w, w2), "c2 int, c int, b double")
    half = df.join(rows, "r").groupBy("r2", "c").agg(F.sum(F.col("v") * F.col("a")).alias("v"))
    return half.join(cols, "c").groupBy("r2", "c2").agg(F.sum(F.col("v") * F.col("b")).alias("v")).select(F.col("r2").alias("r"), F.col("c2").alias("c"), "v")


def doubled(df: DataFrame, h: int, w: int) -> DataFrame:
    """Twice the resolution; new cells are means of the two or four around them."""
    at = lattice(df, 2 * h, 2 * w)
    lo = lambda x: F.floor(F.col(x) / 2).cast("int")
    hi = lambda x, n: F.least(F.floor((F.col(x) + 1) / 2).cast("int"), F.lit(n - 1))
    four = F.array(*(F.struct(a.alias("sr"), b.alias("sc")) for a in (lo("r"), hi("r", h)) for b in (lo("c"), hi("c", w))))
    each = at.select("r", "c", F.explode(four).alias("s")).select("r", "c", "s.sr", "s.sc")
    return looked_up(each, df).groupBy("r", "c").agg(F.avg("v").alias("v"))


def backward(df: DataFrame, h: int, w: int, at: DataFrame) -> DataFrame:
    """(r, c, v): bilinear values of df at the places (y, x) of at (r, c, y, x); null outside of it."""
    y0, x0 = F.floor("y"), F.floor("x")
    inside = (F.col("y") >= 0) & (F.col("y") <= h - 1) & (F.col("x") >= 0) & (F.col("x") <= w - 1)
    fy, fx = F.col("y") - y0, F.col("x") - x0
    corners = F.array(*(F.struct((y0 + i).cast("int").alias("sr"), (x0 + j).cast("int").alias("sc"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("k")) for i in (0, 1) for j in (0, 1)))
    each = at.where(inside).select("r", "c", F.explode(corners).alias("s")).where("s.k > 0").select("r", "c", "s.sr", "s.sc", "s.k")
    cells = df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    found = each.join(cells, ["sr", "sc"]).groupBy("r", "c").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    return at.select("r", "c").join(found, ["r", "c"], "left")


def homography(y: Column, x: Column, m: Sequence[float]) -> list[Column]:
    """Where the projective map with the rows of m takes (y, x); null on the horizon."""
    d = m[6] * y + m[7] * x + m[8]
    return [F.try_divide(m[0] * y + m[1] * x + m[2], d), F.try_divide(m[3] * y + m[4] * x + m[5], d)]


def warped(df: DataFrame, h: int, w: int, m: Sequence[float]) -> DataFrame:
    """df warped by m, which takes a place of the output to its source; the centre is (0, 0) of both."""
    cy, cx = (h - 1) / 2, (w - 1) / 2
    at = lattice(df, h, w)
    y, x = homography(F.col("r") - cy, F.col("c") - cx, m)
    return backward(df, h, w, at.select("r", "c", (y + cy).alias("y"), (x + cx).alias("x")))


def rotated(df: DataFrame, h: int, w: int, degrees: float) -> DataFrame:
    a = math.radians(degrees)
    return warped(df, h, w, (math.cos(a), math.sin(a), 0, -math.sin(a), math.cos(a), 0, 0, 0, 1))


def translated(df: DataFrame, h: int, w: int, dy: float, dx: float) -> DataFrame:
    return warped(df, h, w, (1, 0, -dy, 0, 1, -dx, 0, 0, 1))


def jittered(df: DataFrame, h: int, w: int, angles: Sequence[float], shifts: Sequence[tuple[float, float]]) -> DataFrame:
    """(n, r, c, v): one version for each angle and shift, numbered from 0."""
    out, n = None, 0
    for a in angles:
        for dy, dx in shifts:
            t = math.radians(a)
            m = (math.cos(t), math.sin(t), -dy, -math.sin(t), math.cos(t), -dx, 0, 0, 1)
            one = warped(df, h, w, m).select(F.lit(n).alias("n"), "r", "c", "v")
            out, n = one if out is None else out.unionByName(one), n + 1
    return out


def _spread(df: DataFrame, kernel: Sequence[Sequence[float]], flip: bool) -> DataFrame:
    """(r, c, v, t): each cell at every output of the full size that uses it, with its weight."""
    kh, kw = len(kernel), len(kernel[0])
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(kernel[kh - 1 - i][kw - 1 - j] if flip else kernel[i][j])).alias("t")) for i in range(kh) for j in range(kw)))
    return df.select("r", "c", "v", F.explode(steps).alias("s")).select((F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), "v", "s.t")


def _shaped(df: DataFrame, h: int, w: int, kh: int, kw: int, shape: str) -> DataFrame:
    """The part of a full-size result that shape names, from 0."""
    if shape == "full":
        return df
    dr, dc, rows, cols = (kh // 2, kw // 2, h, w) if shape == "same" else (kh - 1, kw - 1, h - kh + 1, w - kw + 1)
    inside = F.col("r").between(dr, dr + rows - 1) & F.col("c").between(dc, dc + cols - 1)
    return df.where(inside).withColumn("r", F.col("r") - dr).withColumn("c", F.col("c") - dc)


def convolved(df: DataFrame, h: int, w: int, kernel: Sequence[Sequence[float]], shape: str = "full") -> DataFrame:
    """Convolution; shape: full, same (the middle) or valid (where the kernel is inside)."""
    out = _spread(df, kernel, False).groupBy("r", "c").agg(F.sum(F.col("v") * F.col("t")).alias("v"))
    return _shaped(out, h, w, len(kernel), len(kernel[0]), shape)


def correlated(df: DataFrame, h: int, w: int, template: Sequence[Sequence[float]], shape: str = "full") -> DataFrame:
    return convolved(df, h, w, [row[::-1] for row in template[::-1]], shape)


def filter_bank(df: DataFrame, h: int, w: int, kernels: Sequence[Sequence[Sequence[float]]], shape: str = "same") -> DataFrame:
    """(f, r, c, v): responses to each kernel, numbered from 0."""
    out = None
    for f, k in enumerate(kernels):
        one = convolved(df, h, w, k, shape).select(F.lit(f).alias("f"), "r", "c", "v")
        out = one if out is None else out.unionByName(one)
    return out


def squared_distances(df: DataFrame, h: int, w: int, template: Sequence[Sequence[float]]) -> DataFrame:
    """Squared distance of each window inside the grid to the template."""
    out = _spread(df, template, True).groupBy("r", "c").agg(F.sum((F.col("v") - F.col("t")) * (F.col("v") - F.col("t"))).alias("v"))
    return _shaped(out, h, w, len(template), len(template[0]), "valid")


def normalised_correlation(df: DataFrame, h: int, w: int, template: Sequence[Sequence[float]], mask: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Correlation of windows and template, both of mean 0 and norm 1 where mask is 1; 0 for flat windows."""
    mask = mask or [[1.0] * len(template[0])] * len(template)
    cells = [(i, j) for i, row in enumerate(mask) for j, m in enumerate(row) if m]
    mean = sum(template[i][j] for i, j in cells) / len(cells)
    norm = math.sqrt(sum((template[i][j] - mean) ** 2 for i, j in cells))
    flat = [[template[i][j] - mean if mask[i][j] else math.nan for j in range(len(template[0]))] for i in range(len(template))]
    each = _spread(df, flat, True).where(~F.isnan("t"))
    s = each.groupBy("r", "c").agg(F.sum(F.col("v") * F.col("t")).alias("p"), F.sum("v").alias("a"), F.sum(F.col("v") * F.col("v")).alias("b"))
    spread = F.col("b") - F.col("a") * F.col("a") / len(cells)
    v = F.when(spread > 1e-9, F.col("p") / (F.sqrt(spread) * norm)).otherwise(0.0) if norm > 0 else F.lit(0.0)
    return _shaped(s.select("r", "c", v.alias("v")), h, w, len(template), len(template[0]), "valid")


def blocks(df: DataFrame, h: int, w: int, kr: int, kc: int, how: str = "sum") -> DataFrame:
    """Sum, avg, max or min of whole blocks of kr by kc cells; cells beyond the last whole block go."""
    whole = df.where((F.col("r") < h // kr * kr) & (F.col("c") < w // kc * kc))
    return whole.groupBy(F.floor(F.col("r") / kr).cast("int").alias("r"), F.floor(F.col("c") / kc).cast("int").alias("c")).agg({"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]("v").alias("v"))


def window_histograms(df: DataFrame, h: int, w: int, edges: Sequence[float], radius: int) -> DataFrame:
    """(r, c, bin, n): cells of each bin in the square window around each cell, clipped at the borders.
    Bins hold edges[i] <= v < edges[i + 1], the last one its end as well; other values count nowhere."""
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        b = F.when((F.col("v") >= edges[i]) & ((F.col("v") < edges[i + 1]) | ((F.col("v") == edges[i + 1]) & F.lit(i == len(edges) - 2))), i).otherwise(b)
    span = F.sequence(F.lit(-radius), F.lit(radius))
    each = df.select("r", "c", b.alias("bin")).where("bin IS NOT NULL").select("r", "bin", "c", F.explode(span).alias("i")).groupBy((F.col("r") + F.col("i")).alias("r"), "c", "bin").agg(F.count(F.lit(1)).alias("n"))
    each = each.select("r", "bin", "n", "c", F.explode(span).alias("j")).groupBy("r", (F.col("c") + F.col("j")).alias("c"), "bin").agg(F.sum("n").alias("n"))
    return each.where(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))


def moments(df: DataFrame, symmetric: bool = False) -> DataFrame:
    """One row: weight, mean and covariance of the places, weighed by the size of v; symmetric: one
    variance for both axes. Without any weight all are 0."""
    r, c, v = F.col("r"), F.col("c"), F.abs("v")
    s = df.agg(*(F.coalesce(F.sum(x * v), F.lit(0.0)).alias(n) for n, x in (("s", F.lit(1.0)), ("r", r), ("c", c), ("rr", r * r), ("cc", c * c), ("rc", r * c))))
    m = lambda n: F.col(n) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    vr, vc, vrc = m("rr") - m("r") * m("r"), m("cc") - m("c") * m("c"), m("rc") - m("r") * m("c")
    if symmetric:
        vr, vc, vrc = (vr + vc) / 2, (vr + vc) / 2, F.lit(0.0)
    return s.select(F.col("s").alias("weight"), m("r").alias("mr"), m("c").alias("mc"), vr.alias("vr"), vc.alias("vc"), vrc.alias("vrc"))


def dense(points: DataFrame, h: int, w: int, fill: float = 0.0) -> DataFrame:
    """A grid of points (n, r, c, v); of points at one place the one with the last n counts."""
    last = points.groupBy("r", "c").agg(F.max_by("v", "n").alias("v"))
    return lattice(points, h, w).join(last, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(fill)).alias("v"))


def blended(one: DataFrame, two: DataFrame) -> DataFrame:
    """(r, c, v): mean of two grids (r, c, v, m), weighed by m; null where both weigh nothing."""
    both = one.join(two.select("r", "c", F.col("v").alias("v2"), F.col("m").alias("m2")), ["r", "c"])
    total = F.col("m") + F.col("m2")
    return both.select("r", "c", F.when(total != 0, (F.col("m") * F.col("v") + F.col("m2") * F.col("v2")) / total).alias("v"))


def combined(one: DataFrame, two: DataFrame, strongest: bool = False) -> DataFrame:
    """(r, c, v): of two images (r, c, v, m), v an array of five channels and more, at each cell the one whose
    last two of five channels, its gradient, are longer times the mask m (else the second); then channels
    2 and 3, and unless strongest 4 and 5, are means weighed by the masks, null where both weigh nothing."""
    both = one.join(two.select("r", "c", F.col("v").alias("v2"), F.col("m").alias("m2")), ["r", "c"])
    at = lambda v, i: F.get(v, F.lit(i))
    power = lambda v, m: F.col(m) * (at(v, 3) * at(v, 3) + at(v, 4) * at(v, 4))
    base = F.when(power("v", "m") > power("v2", "m2"), F.col("v")).otherwise(F.col("v2"))
    mixed = F.zip_with("v", "v2", lambda a, b: F.try_divide(F.col("m") * a + F.col("m2") * b, F.col("m") + F.col("m2")))
    means = [1, 2] if strongest else [1, 2, 3, 4]
    return both.select("r", "c", F.transform(base, lambda x, i: F.when(i.isin(means), F.get(mixed, i)).otherwise(x)).alias("v"))


def _taps(n: int, m: int) -> list[tuple[int, int, float]]:
    """(output, input, weight) to take n cells to m by linear interpolation; downwards the triangle is as wide
    as an output cell. Cells beyond the border mirror those inside."""
    scale = m / n
    wide = max(1.0, 1 / scale)
    out: dict[tuple[int, int], float] = {}
    for i in range(m):
        u = (i + 0.5) / scale - 0.5
        near = range(math.floor(u - wide), math.ceil(u + wide) + 1)
        weight = {j: max(0.0, 1 - abs(u - j) / wide) for j in near}
        for j, k in weight.items():
            if k > 0:
                j = j % (2 * n)
                j = j if j < n else 2 * n - 1 - j
                out[i, j] = out.get((i, j), 0.0) + k / sum(weight.values())
    return [(i, j, k) for (i, j), k in out.items()]


def scaled_field(df: DataFrame, src: tuple[int, int], new: tuple[int, int], field: tuple[int, int], target: tuple[int, int], patch: int, scales: tuple[float, float] | None = None) -> DataFrame:
    """A field (y, x, ty, tx) of patches for a target and source of other sizes. The field repeats its last
    row and column patch - 1 times, is taken to the new target's size by linear interpolation and loses the last
    patch - 1 rows and columns again; offsets scale with the source (src to new) and stay where a patch fits.

    scales: least and largest size; the field then has angle, sy and sx as well, of which sy and sx are
    brought into these bounds, with their sign.
    """
    more = ["angle", "sy", "sx"] if scales else []
    names = ["ty", "tx", *more]
    spark, extra = df.sparkSession, patch - 1
    (h, w), (h2, w2) = field, target
    at = lattice(df, h + extra, w + extra).select("r", "c", F.least("r", F.lit(h - 1)).alias("y"), F.least("c", F.lit(w - 1)).alias("x"))
    full = at.join(df, ["y", "x"]).select("r", "c", *names)
    rows = spark.createDataFrame([t for t in _taps(h + extra, h2) if t[0] < h2 - extra], "r2 int, r int, a double")
    cols = spark.createDataFrame([t for t in _taps(w + extra, w2) if t[0] < w2 - extra], "c2 int, c int, b double")
    half = full.join(rows, "r").groupBy("r2", "c").agg(*(F.sum(F.col(n) * F.col("a")).alias(n) for n in names))
    made = half.join(cols, "c").groupBy("r2", "c2").agg(*(F.sum(F.col(n) * F.col("b")).alias(n) for n in names))
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    out = [clip(F.col(n) * (new[i] / src[i]), new[i] - patch).alias(n) for i, n in enumerate(("ty", "tx"))]
    if scales:
        bound = lambda v: F.signum(v) * F.least(F.greatest(F.abs(v), F.lit(scales[0])), F.lit(scales[1]))
        out += [F.col("angle"), bound(F.col("sy")).alias("sy"), bound(F.col("sx")).alias("sx")]
    return made.select(F.col("r2").alias("y"), F.col("c2").alias("x"), *out)


def differences(df: DataFrame, h: int, w: int, mask: DataFrame | None = None) -> DataFrame:
    """(axis, row, col, value): entries of the matrices that take each cell less the next one along columns ("x")
    and rows ("y"), over cells numbered column by column; times the mask (r, c, m) at the cell. Zeros aren't given."""
    at = lattice(df, h, w)
    at = at.join(mask.select("r", "c", "m"), ["r", "c"]) if mask is not None else at.withColumn("m", F.lit(1.0))
    me = (F.col("c") * h + F.col("r")).cast("long")
    e = F.array(*(F.struct(F.lit(a).alias("axis"), me.alias("row"), (me + step).alias("col"), (v * F.col("m")).alias("value")) for a, s in (("x", h), ("y", 1)) for step, v in ((0, 1.0), (s, -1.0))))
    out = at.select("r", "c", F.explode(e).alias("e")).where(((F.col("e.axis") == "x") & (F.col("c") < w - 1)) | ((F.col("e.axis") == "y") & (F.col("r") < h - 1)))
    return out.select("e.axis", "e.row", "e.col", "e.value").where("value <> 0")

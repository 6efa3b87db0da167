"""Rules of warps, filters and frames on hand-made cases; places without an answer give null or 0, no error."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import frames, linear
from gridloom.operators import boxes, grid, warps


def table(spark, a):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(np.asarray(a, float))], "r int, c int, v double")


def array(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.r, r.c] = np.nan if r.v is None else r.v
    return out


def test_to_size_of_odd_differences(spark):
    """Five rows to two: two go before them and one behind; two rows to five: one comes before and two behind."""
    a = np.arange(10.0).reshape(5, 2)
    assert array(warps.to_size(table(spark, a), 5, 2, 2, 2), 2, 2).tolist() == [[4, 5], [6, 7]]
    grown = array(warps.to_size(table(spark, a[:2]), 2, 2, 5, 2, -1.0), 5, 2)
    assert grown[:, 0].tolist() == [-1, 0, 2, -1, -1]


def test_horizon_gives_null(spark):
    """A cell on the horizon of a projective map has no place."""
    a = np.arange(9.0).reshape(3, 3)
    out = array(warps.warped(table(spark, a), 3, 3, (1, 0, 0, 0, 1, 0, 0, 1, 0)), 3, 3)
    assert np.isnan(out[:, 1]).all()


def test_moments_without_weight(spark):
    row = warps.moments(table(spark, np.zeros((2, 3)))).first()
    assert row.asDict() == {k: 0.0 for k in ("weight", "mr", "mc", "vr", "vc", "vrc")}
    row = warps.moments(table(spark, [[0, -2], [0, 2]]), symmetric=True).first()
    assert (row.weight, row.mr, row.mc, row.vr, row.vc, row.vrc) == (4, 0.5, 1, 0.125, 0.125, 0)


def test_ellipse_without_axis(spark):
    row = spark.range(1).select(*(c.alias(f"e{i}") for i, c in enumerate(frames.oriented_ellipse([F.lit(v) for v in (1.0, 2.0, 0.0, 0.0, 9.0)])))).first()
    assert tuple(row) == (1, 2, 0, 0, 0, 3)


def mirrored(a, f):
    """A separable stencil over a mirrored image."""
    r = len(f) // 2
    p = np.pad(a, r, mode="symmetric")
    p = np.apply_along_axis(lambda v: np.convolve(v, f, "valid"), 0, p)
    return np.apply_along_axis(lambda v: np.convolve(v, f, "valid"), 1, p)


def test_filters_mirror(spark):
    a = np.random.default_rng(1).normal(size=(6, 9))
    df = table(spark, a)
    assert np.allclose(array(grid.box_filter(df, 2), 6, 9), mirrored(a, [0.2] * 5))
    assert np.allclose(array(grid.triangle_filter(df, 3), 6, 9), mirrored(a, np.array([1, 2, 3, 4, 3, 2, 1]) / 16))
    p = 12 / 0.5 / 2.5 - 2
    assert np.allclose(array(grid.triangle_filter(df, 0.5), 6, 9), mirrored(a, np.array([1, p, 1]) / (2 + p)))
    assert np.allclose(array(grid.box_filter(df, 8), 6, 9), mirrored(a, [1 / 17] * 17))  # wider than the lines
    box = mirrored(a, [1 / 3] * 3)
    assert np.allclose(array(grid.sampled(grid.box_filter(df, 1), 6, 9, 2), 3, 4), box[1:6:2, 1:8:2])


def resized(a, h, w):
    """Linear interpolation, with a wider triangle downwards; symmetric borders."""
    for axis, m in ((0, h), (1, w)):
        n = a.shape[axis]
        k, wide = m / n, max(1.0, n / m)
        p = np.pad(a, [(2 * n, 2 * n) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        rows = []
        for i in range(m):
            u = (i + 0.5) / k - 0.5
            j = np.arange(-2 * n, 3 * n)
            f = np.maximum(0, 1 - np.abs(u - j) / wide)
            rows.append(np.tensordot(f / f.sum(), p, (0, axis)))
        a = np.stack(rows, axis)
    return a


@pytest.mark.parametrize("target", [(13, 11), (5, 4)])
def test_scaled_field(spark, target):
    rng = np.random.default_rng(2)
    names = ["ty", "tx", "angle", "sy", "sx"]
    f = {n: rng.uniform(0, 9, (6, 5)) if n in ("ty", "tx") else rng.normal(size=(6, 5)) for n in names}
    df = spark.createDataFrame([(y, x, *(float(f[n][y, x]) for n in names)) for y in range(6) for x in range(5)], "y int, x int, " + ", ".join(f"{n} double" for n in names))
    got = warps.scaled_field(df, (10, 12), (20, 9), (6, 5), target, 3, (0.5, 1.5)).collect()
    h, w = target[0] - 2, target[1] - 2
    want = {n: resized(np.pad(f[n], ((0, 2), (0, 2)), mode="edge"), *target)[:h, :w] for n in names}
    want["ty"], want["tx"] = np.clip(want["ty"] * 2, 0, 17), np.clip(want["tx"] * 0.75, 0, 6)
    for n in ("sy", "sx"):
        want[n] = np.sign(want[n]) * np.clip(np.abs(want[n]), 0.5, 1.5)
    assert len(got) == h * w
    assert all(math.isclose(r[n], want[n][r.y, r.x], abs_tol=1e-9) for r in got for n in names)


def test_differences(spark):
    """Each cell less the next one, times the mask at the cell."""
    a, m = np.array([[1.0, 4.0, 9.0], [2.0, 2.0, 5.0]]), np.array([[1.0, 2.0, 3.0], [0.0, 1.0, 1.0]])
    mask = table(spark, m).withColumnRenamed("v", "m")
    x = a.T.reshape(-1)  # column by column
    for axis, want in (("x", (a[:, :-1] - a[:, 1:]) * m[:, :-1]), ("y", (a[:-1] - a[1:]) * m[:-1])):
        out = np.zeros(6)
        for e in warps.differences(table(spark, a), 2, 3, mask).where(F.col("axis") == axis).collect():
            out[e["row"]] += e.value * x[e["col"]]
        assert np.allclose(out.reshape(3, 2).T[: want.shape[0], : want.shape[1]], want)


def test_combined(spark):
    """The image with the longer masked gradient; means of channels 2 and 3, and of 4 and 5 unless the strongest counts."""
    one = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 3.0, 4.0], 1.0), (0, 1, [1.0, 2.0, 3.0, 0.0, 1.0], 0.0)], "r int, c int, v array<double>, m double")
    two = spark.createDataFrame([(0, 0, [5.0, 6.0, 7.0, 1.0, 1.0], 3.0), (0, 1, [5.0, 6.0, 7.0, 1.0, 1.0], 0.0)], "r int, c int, v array<double>, m double")
    got = {(r.c, k): r.v for k in (False, True) for r in warps.combined(one, two, k).collect()}
    assert got[0, False] == [1.0, 5.0, 6.0, 1.5, 1.75] and got[0, True] == [1.0, 5.0, 6.0, 3.0, 4.0]
    assert got[1, True] == [5.0, None, None, 1.0, 1.0]  # no mask: no gradient and no mean


def test_systems_of_many_sizes(spark):
    rows = [(1, [2.0, 0.0, 0.0, 4.0], [2.0, 4.0]), (2, [1.0, 2.0, 2.0, 4.0], [1.0, 2.0]), (3, [5.0], [10.0]), (4, None, [1.0]), (5, [1.0, 0.0, 0.0, None], [1.0, 1.0]), (6, [1.0, 2.0], [1.0, 2.0]), (7, [0.0, 1.0, 1.0, 0.0], [3.0, 8.0])]
    df = spark.createDataFrame(rows, "id int, m array<double>, b array<double>").coalesce(1)
    got = {r.id: r.x for r in df.select("id", linear.solve("m", "b").alias("x")).collect()}
    assert got == {1: [1.0, 1.0], 2: None, 3: [2.0], 4: None, 5: None, 6: None, 7: [8.0, 3.0]}


def test_boxes_without_area(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 5.0, 0.0, 0.0, 1.0), (1, 2, 5.0, 5.0, 0.0, 0.0, 2.0), (1, 3, 0.0, 0.0, 9.0, 9.0, 1.0), (1, 4, 0.0, 0.0, 9.0, 8.0, 3.0)], "img int, id int, x double, y double, w double, h double, score double")
    assert sorted(r.id for r in boxes.suppress_max(df).collect()) == [1, 2, 4]
    assert [(r.a, r.b) for r in boxes.overlap_pairs(df, df, 4.0, 0.5, F.col("a_id") < F.col("b_id")).collect()] == [(3, 4)]

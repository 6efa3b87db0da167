"""Randomised patch search against the exact one and against itself in plain Python."""

import hashlib
import math

import numpy as np

from gridloom.operators import patchfield, patchsearch as ps


def grid(spark, a):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "r int, c int, v double").repartition(3)


def draw(*parts):
    return (int(hashlib.md5(",".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 1) / 2**32


def half_up(v):
    return math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)


def plain(a, b, p, rounds, window, gap, seed):
    h, w = b.shape
    rows, cols = h - p + 1, w - p + 1
    ok = lambda y, x, ty, tx: 0 <= ty < rows and 0 <= tx < cols and max(abs(ty - y), abs(tx - x)) >= gap
    dist = lambda y, x, ty, tx: round(float(((a[y : y + p, x : x + p] - b[ty : ty + p, tx : tx + p]) ** 2).mean()), 9)
    field = {}
    for y in range(a.shape[0] - p + 1):
        for x in range(a.shape[1] - p + 1):
            ty, tx = (min(int(draw(seed, -1, k, y, x) * n), n - 1) for k, n in ((0, rows), (1, cols)))
            if not ok(y, x, ty, tx):
                ty, tx = (y + rows // 2) % rows, (x + cols // 2) % cols
            field[y, x] = (dist(y, x, ty, tx), ty, tx)
    for turn in range(rounds):
        step, old = (1 if turn % 2 == 0 else -1), dict(field)
        for (y, x), (_, ty, tx) in old.items():
            for dy, dx in ((step, 0), (0, step)):
                at, to = (y + dy, x + dx), (ty + dy, tx + dx)
                if at in field and ok(*at, *to):
                    field[at] = min(field[at], (dist(*at, *to), *to))
        old = dict(field)
        for (y, x), (_, ty, tx) in old.items():
            reach, k = window, 0
            while reach >= 1:
                to = tuple(t + half_up((2 * draw(seed, turn, k, axis, y, x) - 1) * reach) for axis, t in ((0, ty), (1, tx)))
                if ok(y, x, *to):
                    field[y, x] = min(field[y, x], (dist(y, x, *to), *to))
                reach, k = reach // 2, k + 1
    return field


def test_same_as_plain(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 11)).round(2), rng.normal(size=(10, 8)).round(2)
    for kw, one, two in ((dict(patch=3, seed=4), a, b), (dict(patch=2, window=4, least_gap=2, seed=7), a, a)):
        o = ps.Options(**kw)
        field, means = ps.search(grid(spark, one), grid(spark, two), *two.shape, rounds=2, o=o)
        want = plain(one, two, o.patch, 2, o.window or max(two.shape), o.least_gap, o.seed)
        assert {(r.y, r.x): (r.dist, r.ty, r.tx) for r in field.collect()} == want
        assert math.isclose(means[-1], np.mean([v[0] for v in want.values()])) and means[0] >= means[1] >= means[2]


def test_near_the_exact_one(spark):
    """The mean distance falls each round; five rounds take away 99.8 % of what the start has over an exhaustive search."""
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:20, :24]
    b = np.sin(y / 3) + np.cos(x / 4) + rng.normal(size=y.shape) / 20
    a = b[3:17, 4:20] + rng.normal(size=(14, 16)) / 50
    field, means = ps.search(grid(spark, a), grid(spark, b), 20, 24, rounds=5, o=ps.Options(seed=3))
    exact = patchfield.search(grid(spark, a), grid(spark, b), 3, 24, own=True).agg({"dist": "avg"}).first()[0]
    assert all(u >= v for u, v in zip(means, means[1:], strict=False))
    assert exact <= means[-1] and means[-1] - exact < 0.002 * (means[0] - exact)
    again, more = ps.search(grid(spark, a), grid(spark, b), 20, 24, rounds=1, o=ps.Options(seed=9), start=field)
    assert more[0] == means[-1] and more[1] <= more[0]

"""Generators of planted lattices; energies against plain loops."""

import math

import numpy as np
import pytest

from gridloom.operators import lattice as la


def table(spark, points):
    return spark.createDataFrame([(float(x), float(y)) for x, y in points], "dx double, dy double").repartition(3)


def plain_map(points, sigma):
    reach, out = math.ceil(2 * sigma), {}
    for px, py in points:
        for y in range(math.floor(py) - reach, math.ceil(py) + reach + 1):
            for x in range(math.floor(px) - reach, math.ceil(px) + reach + 1):
                out[x, y] = out.get((x, y), 0) + math.exp(-((px - x) ** 2 + (py - y) ** 2) / (2 * sigma))
    xs, ys = [p[0] for p in out], [p[1] for p in out]
    return out, (min(xs), min(ys), max(xs), max(ys))


def plain_measure(m, bounds, penalty, points, o):
    found = [m.get(p, -penalty) for p in points if p != (0, 0)]
    s, n = sum(found), len(found)
    p, r = (s / n if s > 0 else 0), max(s, 0) / sum(m.values())
    if o.measure == "g":
        return p * r
    return 0 if min(p, r) < 1e-8 else (1 + o.beta**2) * p * r / (o.beta**2 * p + r)


def inside(p, b):
    return b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]


def line(start, step, b):
    return [q for k in range(-200, 201) if inside(q := (start[0] + k * step[0], start[1] + k * step[1]), b)]


@pytest.mark.parametrize("measure", ["f", "g"])
def test_same_as_plain(spark, measure):
    rng = np.random.default_rng(1)
    pts = [(6 * i + 2 * j + e, 7 * j - i + f) for i in range(-2, 3) for j in range(-1, 2) for e, f in rng.normal(0, 0.4, (2, 2))]
    o = la.Options(sigma=1.0, nearest=4.0, measure=measure)
    m, b = plain_map(pts, 1.0)
    got = la.density(table(spark, pts), o)
    assert got.bounds == b and math.isclose(got.total, sum(m.values()))
    assert all(math.isclose(r.e, m[r.x, r.y]) for r in got.cells.collect()) and got.cells.count() == len(m)
    penalty = sum(m.values()) / len(m)
    near = lambda d: math.hypot(*d) >= 4
    firsts = {(x, y): plain_measure(m, b, penalty, line((0, 0), (x, y), b), o) for x in range(b[2] + 1) for y in range(b[1], b[3] + 1) if near((x, y))}
    ranked = sorted((-round(v, 12), y, x) for (x, y), v in firsts.items() if v > 0)[:3]
    assert [(-r.measure, r.dy, r.dx) for r in la.first_generators(got, spark, 3, o).collect()] == [pytest.approx(x) for x in ranked]
    g = ranked[0][2], ranked[0][1]

    def apart(d):
        t = abs(math.atan2(d[1], d[0]) - math.atan2(g[1], g[0]))
        t = 2 * math.pi - t if t > math.pi else t
        return min(t, math.pi - t) if t > math.pi / 2 else t

    seconds = {(x, y): plain_measure(m, b, penalty, [q for u in line((0, 0), g, b) for q in line(u, (x, y), b)], o) for x in range(b[0], b[2] + 1) for y in range(b[3] + 1) if near((x, y)) and apart((x, y)) >= o.angle}
    best = min((-round(v, 12), y, x) for (x, y), v in seconds.items() if v > 0)
    r = la.second_generators(got, la.first_generators(got, spark, 1, o), o).collect()
    assert [(x.gx, x.gy, x.dx, x.dy) for x in r] == [(*g, best[2], best[1])] and math.isclose(r[0].measure, -best[0], rel_tol=1e-6)


def test_planted(spark):
    """The generators of a noisy lattice span it."""
    rng = np.random.default_rng(2)
    pts = [(11 * i + 3 * j + e, 9 * j - 2 * i + f) for i in range(-3, 4) for j in range(-3, 4) if (i, j) != (0, 0) for e, f in rng.normal(0, 0.3, (4, 2))]
    pts += [tuple(p) for p in rng.uniform(-30, 30, (20, 2))]
    g, h, measure = la.generators(table(spark, pts), 5, la.Options(sigma=1.0))
    # a basis of the same lattice: whole coordinates, and the area of a cell
    basis = np.array([[11, 3], [-2, 9]])
    at = np.linalg.solve(basis, np.array([g, h]).T)
    assert np.allclose(at, np.round(at), atol=0.15) and abs(round(float(np.linalg.det(np.round(at))))) == 1 and measure > 0


def test_none(spark):
    assert la.generators(table(spark, []).limit(0)) is None
    assert la.generators(table(spark, [(1.0, 0.0)]), o=la.Options(sigma=1.0, nearest=500.0)) is None

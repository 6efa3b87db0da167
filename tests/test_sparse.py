"""Conjugate gradients against dense solutions."""

import numpy as np
import pytest

from gridloom.operators import sparse


def test_poisson(spark):
    h, w, weight = 7, 9, 3.0
    rng = np.random.default_rng(1)
    v, dx, dy = (rng.normal(size=(h, w)) * k for k in (5, 1, 1))
    m = rng.integers(0, 2, (h, w)).astype(float)
    dx[2, 3] = 500.0  # counts as no difference
    cells = spark.createDataFrame([(r, c, float(v[r, c]), float(m[r, c]), float(dx[r, c]), float(dy[r, c])) for r in range(h) for c in range(w)], "r int, c int, v double, m double, dx double, dy double")
    got, norms = sparse.poisson(cells, h, w, weight, tolerance=1e-9)
    # the dense system
    a, b = [], []
    at = lambda r, c: c * h + r
    for r in range(h):
        for c in range(w):
            k = 1 + 100 * (1 - m[r, c])
            row = np.zeros(h * w)
            row[at(r, c)] = k
            a.append(row)
            b.append(k * v[r, c])
            for ok, other, d in ((c < w - 1, (r, c + 1), dx), (r < h - 1, (r + 1, c), dy)):
                if ok:
                    row = np.zeros(h * w)
                    row[at(r, c)], row[at(*other)] = weight * k, -weight * k
                    a.append(row)
                    b.append(weight * k * (0 if abs(d[r, c]) > 100 else d[r, c]))
    want = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
    assert all(np.isclose(r.v, want[at(r.r, r.c)], atol=1e-6) for r in got.collect()) and got.count() == h * w
    assert norms[0] == 1 and norms[-1] <= 1e-9 and len(norms) < h * w


def test_rounds(spark):
    n = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i long, j long, v double")
    right = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    x, norms = sparse.conjugate_gradients(n, right)
    assert {r.i: pytest.approx(r.v) for r in x.collect()} == {0: 1 / 11, 1: 7 / 11} and len(norms) == 3
    one, norms = sparse.conjugate_gradients(n, right, rounds=1)
    assert len(norms) == 2 and norms[1] > 1e-3
    zero, norms = sparse.conjugate_gradients(n, right.where("i > 5"))
    assert norms == [0.0] and all(r.v == 0 for r in zero.collect())

"""k-d forests against all pairs."""

import numpy as np
import pytest

from gridloom.operators import kdforest as kd


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


def brute(x, q, k):
    d = ((q[:, None, :] - x[None]) ** 2).sum(2)
    return {i: sorted((round(v, 9), j) for j, v in enumerate(r))[:k] for i, r in enumerate(d)}


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r.place):
        out.setdefault(r["query"], []).append((round(r.distance, 9), r.id))
    return out


@pytest.mark.parametrize("method,trees", [("median", 1), ("mean", 1), ("median", 3)])
def test_exact(spark, method, trees):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(1000, 10)), rng.normal(size=(10, 10))
    index = kd.build(frame(spark, x), trees=trees, cells=16, method=method, block=40, leaf=8)
    assert all(s.sum() == 1000 and len(s) == 16 for s in index.sizes)
    assert index.blocks.agg({"n": "sum"}).first()[0] == 1000 * trees
    assert found(kd.search(index, frame(spark, q), 7)) == brute(x, q, 7)
    assert found(kd.search(index, frame(spark, q), 1, growth=(2,))) == brute(x, q, 1)


def test_fewer_comparisons(spark):
    """In few dimensions most of the base isn't looked at."""
    rng = np.random.default_rng(1)
    x, q = rng.random((4000, 3)), rng.random((50, 3))
    index = kd.build(frame(spark, x), cells=32, block=200, leaf=16)
    rows = kd.search(index, frame(spark, q), 5)
    assert found(rows) == brute(x, q, 5)
    assert rows.agg({"compared": "max"}).first()[0] < 1000


def test_limit(spark):
    """A limit of half the base finds most neighbours, a forest more than a tree."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(1000, 10)), rng.normal(size=(40, 10))
    want = brute(x, q, 7)
    share = {}
    for trees in (1, 5):
        index = kd.build(frame(spark, x), trees=trees, cells=32, block=64, leaf=8)
        got = found(kd.search(index, frame(spark, q), 7, limit=350))
        share[trees] = np.mean([len(set(got[i]) & set(want[i])) / 7 for i in want])
        assert all(len(r) == 7 for r in got.values())
    assert share[1] > 0.6 and share[5] > 0.6


def test_odd(spark):
    x = np.array([[1.0, 1.0]] * 50 + [[2.0, 1.0]])
    index = kd.build(frame(spark, x), cells=8, block=10, leaf=4)
    got = found(kd.search(index, frame(spark, np.array([[1.0, 1.0]])), 3))
    assert got == {0: [(0.0, 0), (0.0, 1), (0.0, 2)]}
    near = kd.search(index, frame(spark, x), 60, skip_self=True).groupBy("query").count().collect()
    assert len(near) == 51 and all(r["count"] == 50 for r in near)
    mixed = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [3.0, 4.0])], "id long, x array<double>")
    assert found(kd.search(kd.build(mixed), frame(spark, np.zeros((1, 2))), 5)) == {0: [(0.0, 1), (25.0, 4)]}
    assert kd.search(kd.build(mixed.limit(0)), frame(spark, np.zeros((1, 2))), 2).count() == 0

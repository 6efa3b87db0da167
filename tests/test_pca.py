"""Principal components against numpy."""

import numpy as np
import pytest

from gridloom.operators import pca


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)


def test_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7)) + 1e4  # far from 0: the means go first
    b = pca.fit(frame(spark, x))
    cov = np.cov(x.T)
    assert np.allclose(b.mean, x.mean(0)) and b.rows == 200
    assert np.allclose(b.variances, np.sort(np.linalg.eigvalsh(cov))[::-1])
    assert np.allclose(cov @ b.components.T, b.components.T * b.variances) and np.allclose(b.components @ b.components.T, np.eye(7))
    assert all(u[np.abs(u).argmax()] > 0 for u in b.components)
    got = {(r.i, r.j): r.v for r in pca.covariance(frame(spark, x)).collect()}
    assert all(np.isclose(got[i, j], cov[i, j]) for i in range(7) for j in range(i, 7)) and len(got) == 28
    assert np.isclose(b.shares()[-1], 1)


def test_fewer_rows_than_components(spark):
    x = np.random.default_rng(2).normal(size=(4, 6))
    b = pca.fit(frame(spark, x), least=1e-12)
    assert len(b.variances) == 3  # what is left after the mean
    out = pca.apply(frame(spark, x), b, 3).collect()
    assert all(np.allclose(r.xhat, x[r.id]) for r in out)


def test_apply(spark):
    x = np.random.default_rng(3).normal(size=(100, 5)) * [5, 4, 3, 2, 1]
    b = pca.fit(frame(spark, x))
    for k in (0, 2, 5):
        back = (x - b.mean) @ b.components[:k].T @ b.components[:k] + b.mean
        got = {r.id: r for r in pca.apply(frame(spark, x), b, k).collect()}
        assert all(np.allclose(got[i].xhat, back[i]) and len(got[i].y) == k for i in range(100))
        assert np.isclose(pca.residual(frame(spark, x), b, k), b.variances[k:].sum() / b.variances.sum(), atol=1e-9)


def test_odd(spark):
    one = pca.fit(frame(spark, np.array([[1.0, 2.0]])))
    assert one.mean.tolist() == [1, 2] and one.variances.tolist() == [0]
    assert pca.fit(spark.createDataFrame([], "id long, x array<double>")).rows == 0
    assert len(pca.fit(frame(spark, np.ones((5, 3)))).variances) == 0
    with pytest.raises(ValueError):
        pca.fit(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, x array<double>"))


def test_random_vectors(spark):
    x = np.random.default_rng(4).normal(size=(300, 4)) * [3, 2, 1, 0.1]
    b = pca.fit(frame(spark, x))
    on = np.array([r.x for r in pca.random_vectors(spark, b, 3, 50, radius=2.0).collect()])
    y = (on - b.mean) @ b.components[:3].T / np.sqrt(b.variances[:3])
    assert np.allclose(np.linalg.norm(y, axis=1), 2)
    free = np.array([r.x for r in pca.random_vectors(spark, b, 4, 3000, radius=0.0).collect()])
    assert np.allclose(np.cov(free.T), np.cov(x.T), atol=0.6)

"""Mean shift against a loop over points."""

import numpy as np
import pytest

from gridloom.operators import meanshift as ms


def plain(x, radius, rate, rounds, blur):
    data, cur = x.copy(), x.copy()
    live = np.ones(len(x), bool)
    for _ in range(rounds):
        base = cur.copy() if blur else data
        new = cur.copy()
        for i in np.flatnonzero(live):
            near = ((base - cur[i]) ** 2).sum(1) < radius**2
            if near.any():
                new[i] = (1 - rate) * cur[i] + rate * base[near].mean(0)
            live[i] = ((new[i] - cur[i]) ** 2).sum() > 1e-3
        cur = new
        if not live.any():
            break
    first = np.full(len(x), -1)
    for i in range(len(x)):
        if first[i] < 0:
            near = (((cur - cur[i]) ** 2).sum(1) < radius**2) & (first < 0)
            first[near] = i
    return cur, first


def table(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double").repartition(3)


@pytest.mark.parametrize("blur,rate", [(False, 0.5), (True, 1.0)])
def test_same_as_plain(spark, blur, rate):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.6, (n, 2)) for c, n in (((0, 0), 25), ((4, 1), 20), ((1, 5), 15))])
    x = np.concatenate((x, x[:3], [[20.0, 20.0], [-9.0, 4.0]]))
    rng.shuffle(x)
    modes, first = plain(x, 1.5, rate, 5, blur)
    got = {r.id: (r.x, r.y) for r in ms.modes(table(spark, x), 1.5, rate, 5, blur).collect()}
    assert np.allclose([got[i] for i in range(len(x))], modes)
    labels, means = ms.mean_shift(table(spark, x), 1.5, rate, 5, 2, blur)
    sizes = np.bincount(first, minlength=len(x))
    order = [k for k in sorted(range(len(x)), key=lambda k: (-sizes[k], k)) if sizes[k]]
    want = {i: order.index(f) + 1 if sizes[f] >= 2 else -1 for i, f in enumerate(first)}
    assert {r.id: r.cluster for r in labels.collect()} == want
    for r in means.collect():
        assert np.allclose([r.x, r.y], modes[first == order[r.cluster - 1]].mean(0)) and r.n == sizes[order[r.cluster - 1]]


def test_order_of_clusters(spark):
    """A chain of points, each near the next: clusters are taken in the order of ids."""
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.permutation(60) * 0.4, rng.normal(0, 0.2, 60)))
    got = {r.id: r.first for r in ms.consolidated(table(spark, x), 1.0).collect()}
    first = np.full(60, -1)
    for i in range(60):
        if first[i] < 0:
            first[(((x - x[i]) ** 2).sum(1) < 1.0) & (first < 0)] = i
    assert got == dict(enumerate(first.tolist()))
    assert ms.consolidated(table(spark, x).limit(0), 1.0).count() == 0


def test_until_rest(spark, tmp_path):
    """The query goes on until all points have stopped, here after more than five rounds; odd rows are left out."""
    from gridloom.plans import catalog

    n = np.repeat(np.arange(1, 21), np.arange(1, 21) // 4 + 1)  # denser and denser
    x = np.column_stack((n.astype(float), np.arange(len(n)) % 7.0))
    modes, first = plain(x, 8.0, 1.0, 10**6, False)
    assert not np.allclose(modes, plain(x, 8.0, 1.0, 5, False)[0])
    rows = [(i, float(b)) for i, (a, b) in enumerate(x) for _ in range(int(a))] + [(100, None), (101, float("nan"))]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.x, r.y, r.n) for r in catalog.QUERIES["mean_shift_clusters"](spark, str(tmp_path)).collect()}
    means = [modes[first == k].mean(0).round(6) for k in np.unique(first)]
    assert {n for *_, n in got} == set(np.bincount(first)[np.unique(first)]) and len(got) == len(means)
    assert all(any(np.allclose(m, g[:2], atol=2e-6) for g in got) for m in means)


def test_tiles():
    """Sums over circles, as by all pairs; places at exactly the radius aren't within."""
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(0, 3, (900, 2)), rng.integers(-9, 9, (300, 2)), np.full((50, 2), 2.0), [[1e6, 3.0]]))
    n = rng.integers(1, 5, len(x))
    p = np.concatenate((rng.normal(0, 4, (150, 2)), rng.integers(-9, 9, (80, 2)), [[500.0, 0.0], [1e6, 3.0]]))
    for radius in (0.5, 5.0, 40.0):
        tiles = ms.Tiles(x[:, 0], x[:, 1], n)
        near = (((p[:, None] - x[None]) ** 2).sum(2) < radius**2) * n
        got = tiles.within(p[:, 0], p[:, 1], radius)
        assert np.array_equal(got[:, 0], near.sum(1))
        assert np.allclose(got[:, 1:], near @ (x - tiles.at), atol=1e-6)


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_climb_in_tasks(spark, monkeypatch, chunk):
    """Points climb in their cell without a Spark job a round; crowded cells go by steps and end at the same places."""
    cuts, cut = [], ms.cut_lineage
    monkeypatch.setattr(ms, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(ms, "CHUNK", chunk)
    x = np.random.default_rng(7).normal(5, 1.5, (150, 2))
    rounds = None if chunk > 40 else 3
    modes, _ = plain(x, 10.0 if chunk > 40 else 2.0, 0.05, 10**6 if rounds is None else rounds, False)
    got = {r.id: (r.x, r.y) for r in ms.modes(table(spark, x), 10.0 if chunk > 40 else 2.0, 0.05, rounds).collect()}
    assert np.allclose([got[i] for i in range(len(x))], modes)
    if chunk > 40:
        assert np.flatnonzero([np.allclose(plain(x, 10.0, 0.05, r, False)[0], modes) for r in range(1, 13)]).size == 0 and len(cuts) < 8

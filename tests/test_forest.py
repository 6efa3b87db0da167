"""Forests against a plain trainer, stumps and boosted ferns against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import forest as fo


def table(seed, n=300, width=6, classes=3):
    rng = np.random.default_rng(seed)
    cls = rng.integers(1, classes + 1, n)
    x = rng.normal(size=(n, width)).round(1) + cls[:, None] * rng.normal(size=width).round(1)
    x[rng.random((n, width)) < 0.02] = np.nan
    return x, cls


def frame(spark, x, cls, w=None):
    rows = [(i, [None if math.isnan(v) else float(v) for v in r], int(c), float(w[i]) if w is not None else 1.0) for i, (r, c) in enumerate(zip(x, cls, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, cls int, w double").repartition(5)


def draw(*parts):
    return (int(hashlib.md5(",".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 1) / 2**32


def impurity(w, criterion):
    s = w.sum()
    if criterion == "gini":
        return 1 - ((w / s) ** 2).sum()
    p = w[w > 0] / s
    return -(p * np.log2(p)).sum()


def split_value(left, right, criterion):
    w = left.sum() + right.sum()
    if criterion == "twoing":
        return -left.sum() / w * right.sum() / w * np.abs(left / left.sum() - right / right.sum()).sum() ** 2
    return left.sum() / w * impurity(left, criterion) + right.sum() / w * impurity(right, criterion)


def plain_tree(t, x, cls, w, edges, o):
    """One tree after another, node by node."""
    n, width = len(cls), x.shape[1]
    ids = np.arange(n)
    take = min(n, o.rows or round(5 * n / o.trees))
    if take < n:
        ids = np.array(sorted(range(n), key=lambda i: (-math.log(draw(o.seed, t, i)) / w[i], i))[:take])
    k = min(width, o.features or max(1, round(width**0.5)))
    nodes, todo = {1: (ids, 0)}, [1]
    out, free = {}, 2
    while todo:
        node = todo.pop(0)
        rows, depth = nodes[node]
        count = np.bincount(cls[rows], minlength=o.classes + 1)[1:]
        out[node] = [None, None, 0, count / count.sum(), int(count.argmax()) + 1, len(rows), depth]
        if (count > 0).sum() < 2 or len(rows) <= max(1, o.least_count, o.least_child) or depth > o.depth:
            continue
        feats = sorted(sorted(range(width), key=lambda f: (-math.log(draw(o.seed, -1, t, node, f)), f))[:k]) if k < width else range(width)
        best = None
        weight = lambda r: np.bincount(cls[r], w[r], o.classes + 1)[1:]
        start = impurity(weight(rows), o.criterion) if o.criterion != "twoing" else 0.0
        for f in feats:
            for c, e in enumerate(edges[f]):
                left = x[rows, f] < e
                if left.any() and not left.all():
                    v = round(split_value(weight(rows[left]), weight(rows[~left]), o.criterion), 10)
                    if best is None or v < best[0]:
                        best = v, f, c, left
        if best and start - best[0] > 1e-10 and min(best[3].sum(), (~best[3]).sum()) >= o.least_child:
            out[node][:3] = best[1], edges[best[1]][best[2]], free
            for r in (rows[best[3]], rows[~best[3]]):
                nodes[free] = r, depth + 1
                todo.append(free)
                free += 1
    return out


def as_dict(model):
    return {(r.tree, r.node): [r.fid, r.thr, r.child, np.array(r.distr), r.hs, r["count"], r.depth] for r in model.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, a in got.items():
        b = want[k]
        assert a[0] == b[0] and a[2] == b[2] and a[4:] == b[4:] and np.allclose(a[3], b[3]) and (a[1] is None or math.isclose(a[1], b[1])), k


OPTIONS = [
    dict(trees=1, features=6, depth=5),
    dict(trees=3, rows=120, depth=3, criterion="entropy", least_count=8, least_child=3),
    dict(trees=2, rows=200, features=4, criterion="twoing", depth=4, least_child=5, seed=9),
    dict(trees=12, depth=0),
]


@pytest.mark.parametrize("k", range(len(OPTIONS)))
def test_train(spark, k):
    x, cls = table(k)
    w = np.random.default_rng(k).integers(1, 4, len(cls)) / 2 if k in (1, 2) else np.ones(len(cls))
    o = fo.Options(classes=3, **OPTIONS[k])
    rows = frame(spark, x, cls, w)
    edges = fo.uniform_edges(rows, 8)
    got = as_dict(fo.train(rows, edges, o))
    want = {(t, n): v for t in range(o.trees) for n, v in plain_tree(t, x, cls, w, edges, o).items()}
    same(got, want)


def test_apply_both_ways(spark):
    x, cls = table(3)
    rows = frame(spark, x, cls)
    model = fo.train(rows, fo.quantile_edges(rows, 32), fo.Options(classes=3, trees=5, depth=8))
    nodes = as_dict(model)
    for kw in ({}, {"depth": 2}, {"count": 20}, {"best": True}):
        def leaf(t, r, kw=kw):
            node = 1
            while True:
                f, thr, child, *_, count, depth = nodes[t, node]
                if not child or (kw.get("depth") and depth >= kw["depth"]) or (kw.get("count") and count <= kw["count"]):
                    return node
                node = child if r[f] < thr else child + 1
        got = {r.id: (r.hs, r.ps) for r in fo.apply(rows, model, **kw).collect()}
        joined = {r.id: (r.hs, r.ps) for r in fo.apply(rows, model, sent=0, **kw).collect()}
        assert got == joined and len(got) == len(cls)
        for i, r in enumerate(x):
            parts = [nodes[t, leaf(t, r)] for t in range(5)]
            ps = np.mean([np.eye(3)[p[4] - 1] if kw.get("best") else p[3] for p in parts], axis=0)
            assert np.allclose(got[i][1], ps) and got[i][0] == int(np.round(ps, 12).argmax()) + 1
    assert np.mean([got[i][0] == c for i, c in enumerate(cls)]) > 0.8


def test_one_class_and_empty(spark):
    rows = frame(spark, np.zeros((5, 2)), np.ones(5, int))
    made = fo.train(rows, fo.uniform_edges(rows, 4), fo.Options(classes=2)).collect()
    assert [(r.node, r.child, r.hs, r["count"]) for r in made] == [(1, 0, 1, 5)]
    same_values = frame(spark, np.zeros((6, 2)), np.array([1, 2] * 3))
    assert fo.train(same_values, fo.uniform_edges(same_values, 4), fo.Options(classes=2)).count() == 1


def test_sampled(spark):
    rows = spark.range(2000).select("id", (1.0 + (F.col("id") % 3) * 2).alias("w"))
    got = fo.sampled(rows, 2, 500, 4).groupBy("tree").agg(F.collect_set("id").alias("ids")).collect()
    for r in got:
        want = sorted(range(2000), key=lambda i: (-math.log(draw(4, r.tree, i)) / (1.0 + i % 3 * 2), i))[:500]
        assert set(r.ids) == set(want)


def test_quantile_edges(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [2.0, 5.0], [4.0, 5.0]])
    e = fo.quantile_edges(frame(spark, x, np.ones(4, int)), 8)
    assert e[0][:2].tolist() == [1.5, 3.0] and np.isinf(e[0][2:]).all() and np.isinf(e[1]).all()


def test_stumps(spark):
    rng = np.random.default_rng(2)
    x, cls, w = rng.normal(size=(80, 4)), rng.integers(0, 2, 80), rng.random(80)
    w /= w.sum()
    rows = frame(spark, x, cls, w)
    edges = fo.uniform_edges(rows, 16)
    got = {r.f: (r.err, r.thr) for r in fo.stumps(fo.binned(rows, edges), 16).collect()}
    for f in range(4):
        errors = []
        for c in range(16):
            low = x[:, f] < (edges[f][c] if c < 15 else np.inf)
            e = w[(cls == 1) & ~low].sum() + w[(cls == 0) & low].sum()
            errors.append(min(round(e, 12), round(1 - e, 12)))
        assert math.isclose(got[f][0], min(errors), abs_tol=1e-9) and math.isclose(errors[got[f][1]], min(errors), abs_tol=1e-9)


@pytest.mark.parametrize("average", [False, True])
def test_ferns(spark, average):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = np.cos(4 * x[:, 0]) + x[:, 1] ** 2
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(3)
    ferns = fo.train_ferns(rows, 25, 3, depth=3, tries=6, eta=0.5, average=average, seed=1)
    # the same draws, in a loop over rows
    draws = np.random.default_rng(1)
    total, want = np.zeros(400), []
    for m in range(1, 26):
        t = (m if average else 1) * y - total
        tries = []
        for fids, thrs in [(draws.integers(0, 3, 3), draws.random(3)) for _ in range(6)]:
            at = [sum(int(r[f] < v) << (2 - k) for k, (f, v) in enumerate(zip(fids, thrs, strict=True))) for r in x]
            mu = t.mean()
            leaf = np.array([sum(t[i] - mu for i in range(400) if at[i] == c) / (at.count(c) + 0.01 * 400) + mu for c in range(8)])
            tries.append((((t - leaf[at]) ** 2).sum(), leaf, at))
        error, leaf, at = min(tries, key=lambda v: v[0])
        if error > (t**2).sum():
            break
        eta = 1.0 if average else 0.5
        want.append(leaf * eta)
        total += leaf[at] * eta
    scale = len(want) if average else 1
    assert len(ferns) == len(want) > 5
    assert all(np.allclose(f.values, v / scale) for f, v in zip(ferns, want, strict=True))
    got = {r.id: r.y for r in fo.apply_ferns(rows, ferns, 3).collect()}
    assert np.allclose([got[i] for i in range(400)], total / scale)

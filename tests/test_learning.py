"""Linear machines, seeding, trees of merged words: against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import linear
from gridloom.functions import svm as fs
from gridloom.operators import aib, quantise, svm


def machine(spark, n=120, dims=3, parts=3):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dims))
    y = np.where(x @ np.arange(1, dims + 1) + 0.3 * rng.standard_normal(n) > 0.2, 1, -1)
    return x, y, spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(parts)


def objective(x, y, w, b, lam, loss):
    s, m = x @ w + b, y * (x @ w + b)
    each = {"hinge": np.maximum(0, 1 - m), "hinge2": np.maximum(0, 1 - m) ** 2, "l1": abs(y - s), "l2": (y - s) ** 2, "logistic": np.log1p(np.exp(-m))}[loss]
    return lam / 2 * (w @ w + b * b) + each.mean()


@pytest.mark.parametrize("loss", ["hinge", "l2", "logistic"])
def test_dual_ascent_closes_the_gap(spark, loss):
    x, y, df = machine(spark)
    m = svm.dual_ascent(df, loss, lam=0.1, epochs=8, gap=0.02)
    for r in m.rounds:
        assert r["objective"] >= r["dual"] - 1e-9
    assert m.rounds[-1]["gap"] < 0.1 and m.rounds[-1]["gap"] < m.rounds[0]["gap"] + 1e-9
    assert m.rounds[-1]["objective"] == pytest.approx(objective(x, y, np.array(m.w), m.b, 0.1, loss), abs=1e-9)


def test_gradient_descent(spark):
    x, y, df = machine(spark)
    m = svm.gradient_descent(df, "hinge", lam=0.1, epochs=3)
    w, b = np.zeros(3), 0.0
    for t in range(3):
        by = np.where(y * (x @ w + b) < 1, -y, 0)
        rate = 1 / (0.1 * (t + 1))
        w, b = w - rate * (0.1 * w + (by[:, None] * x).mean(axis=0)), b - rate * (0.1 * b + by.mean())
    assert m.w == pytest.approx(w.tolist()) and m.b == pytest.approx(b)
    empty = svm.train(df.limit(0), "sgd", epochs=2)
    assert empty.w == [] and svm.train(df.limit(0), "sdca").w == []


@pytest.mark.parametrize("loss", fs.LOSSES)
def test_dual_steps_are_best(spark, loss):
    """No other step gives a larger dual value; the row form and the column form agree."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(20):
        y = float(rng.choice([-1, 1]))
        a = y * float(rng.uniform(0.05, 0.9))
        rows.append((a, float(rng.normal()), float(rng.uniform(0.3, 3)), y))
    df = spark.createDataFrame(rows, "a double, s double, q double, y double")
    got = df.select("*", fs.dual_step(loss, F.col("a"), F.col("s"), F.col("q"), F.col("y")).alias("step")).collect()
    for r in got:
        assert r.step == pytest.approx(svm.dual_step(loss, r.a, r.s, r.q, r.y), abs=1e-9)
    tried = spark.createDataFrame([(r.a, r.s, r.q, r.y, r.step, k / 50) for r in got for k in range(-50, 51)], "a double, s double, q double, y double, step double, other double")
    value = lambda d: -fs.conjugate(loss, -(F.col("a") + F.col(d)), F.col("y")) - F.col("s") * F.col(d) - F.col("q") * F.col(d) * F.col(d) / 2
    assert tried.where(value("other") > value("step") + 1e-6).count() == 0


def plain_merges(joint):
    p, nodes, out = joint / joint.sum(), {}, []
    nodes = {i: p[i] for i in range(len(p))}
    while len(nodes) > 1:
        best = None
        for i in nodes:
            for j in nodes:
                if i < j:
                    rest = [nodes[k] for k in nodes if k not in (i, j)] + [nodes[i] + nodes[j]]
                    d = round(max(aib.information(np.array(list(nodes.values()))) - aib.information(np.array(rest)), 0), 12)
                    best = min(best, (d, i, j)) if best else (d, i, j)
        new = len(p) + len(out)
        nodes[new] = nodes.pop(best[1]) + nodes.pop(best[2])
        out.append((best[1], best[2], new))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_merged_words(seed):
    joint = np.random.default_rng(seed).integers(1, 50, (9, 4)).astype(float)
    steps, left = aib.merge_words(joint)
    assert steps == plain_merges(joint)
    assert all(a >= b - 1e-12 for a, b in zip(left, left[1:], strict=False)) and left[-1] == pytest.approx(0)


def test_tree_and_cut(spark):
    rows = [(w, c, (w * 7 + c * 3) % 11) for w in range(6) for c in range(3)]
    tree, left = aib.tree(spark.createDataFrame(rows, "word int, class int, n int"))
    assert tree.count() == 11 and len(left) == 6
    for k in (1, 3, 6):
        assert aib.cut(tree, 6, k).select("cluster").distinct().count() == k


def test_spread_centres_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(6)], "id long, x array<double>")
    assert quantise.spread_centres(df, 5).count() == 2
    assert quantise.spread_centres(df.limit(0), 2).count() == 0
    modes = quantise.fit_mixture(df, 2, "kmeans++", 2)
    assert modes.count() == 2 and modes.agg(F.sum("prior")).first()[0] == pytest.approx(1)


def test_whole_kmeans_settles(spark):
    rows = [(i, [10 * (i % 3), 5 + i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<long>").withColumn("node", F.lit(0).cast("long"))
    c = quantise.whole_kmeans(df, 3, 20)
    one = quantise.whole_centres(quantise.whole_assign(df, c))
    assert {(r.k, tuple(r.c)) for r in one.collect()} == {(r.k, tuple(r.c)) for r in c.collect()}


def test_solve_odd_rows(spark):
    rows = [([1.0, 2.0, 2.0, 4.0], [1.0, 2.0]), (None, [1.0]), ([4.0], [2.0]), ([0.0, 1.0, 1.0, 0.0], [3.0, 5.0])]
    df = spark.createDataFrame(rows, "m array<double>, b array<double>").repartition(1)
    got = [r[0] for r in df.select(linear.solve("m", "b")).collect()]
    assert got.count(None) == 2 and [0.5] in got and [5.0, 3.0] in got

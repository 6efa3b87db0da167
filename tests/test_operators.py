"""Literal cases of the array operators."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import colour, math as fm, text
from gridloom.operators import bins, boxes, cluster, encode, grid, intervals, metrics, neighbors, patchfield, ranked, trees
from gridloom.sources import readers
from gridloom.streaming import windows


def rows_of(spark, labels, scores):
    return spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(labels, scores, strict=True))], "id int, label int, score double")


@pytest.mark.parametrize(
    "scores,tpr,tnr,auc,eer",
    [([5, 4, 3, 2, 1], [0.5, 1, 1, 1, 1], [1, 1, 2 / 3, 1 / 3, 0], 1.0, 0.0), ([5, 3, 4, 2, 1], [0.5, 0.5, 1, 1, 1], [1, 2 / 3, 2 / 3, 1 / 3, 0], 1 - 1 / 6, 1 / 3)],
)
def test_roc(spark, scores, tpr, tnr, auc, eer):
    df = rows_of(spark, [1, 1, -1, -1, -1], scores)
    got = ranked.roc(df).orderBy("rank").collect()
    assert [r.tpr for r in got] == pytest.approx(tpr) and [r.tnr for r in got] == pytest.approx(tnr)
    s = ranked.roc_summary(df).first()
    assert s.auc == pytest.approx(auc) and s.eer == pytest.approx(eer)


def test_pr(spark):
    s = ranked.pr_summary(rows_of(spark, [1, 1, -1, -1, -1], [5, 3, 4, 2, 1])).first()
    assert s.auc == pytest.approx(0.5 + 0.5 * (0.5 + 2 / 3) / 2) and s.ap == pytest.approx((1 + 2 / 3) / 2)
    assert s.ap11 == pytest.approx((6 + 5 * 2 / 3) / 11)
    inf = float("-inf")
    df = rows_of(spark, [1, 1, -1, -1, -1, -1], [1, inf, -1, -1, -1, -1])
    a, b = ranked.pr_summary(df, True).first(), ranked.pr_summary(df).first()
    assert (b.auc, b.ap, b.ap11) == pytest.approx((0.5, 0.5, 6 / 11))
    assert a.ap == pytest.approx(0.5 + 2 / 6 * 0.5) and a.auc == pytest.approx(0.5 + (1 / 5 + 2 / 6) / 2 * 0.5)


@pytest.mark.parametrize("edges,want", [([], [0] * 5), ([-math.inf, 0], [1, 1, 2, 2, 2]), ([-math.inf], [1] * 5), ([-math.inf, math.inf], [1, 1, 1, 1, 2])])
def test_bin_search(spark, edges, want):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([-math.inf, -1.0, 0.0, 1.0, math.inf])], "i int, x double")
    assert [r.b for r in df.select("i", bins.bin_search(F.col("x"), edges).alias("b")).orderBy("i").collect()] == want


def test_bin_sum_and_histogram(spark):
    acc = spark.createDataFrame([(1, 1), (2, 7)], "bin int, value int")
    v = spark.createDataFrame([(b, -1) for b in [1, 2, 2, 2, 2, 2, 2, 2, 0]], "b int, v int")
    assert {r.bin: r.value for r in bins.bin_sum(v, "b", "v", acc).collect()} == {1: 0, 2: 0}
    w = spark.createDataFrame([(1.0, float(k)) for k in range(1, 11)] + [(math.nan, 5.0), (2.0, 9.0)], "x double, w double")
    assert [tuple(r) for r in bins.weighted_histogram(w, "x", "w", [1.0]).collect()] == [(1, 55.0)]


def test_hash_count(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1), (0, 0)], "a int, b int")
    assert sorted(map(tuple, bins.hash_count(df, ["a", "b"]).collect())) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0)], "g string, x double, w double")
    assert {r.g: r.median for r in ranked.weighted_median(df, "g", "x", "w").collect()} == {"a": 3.0, "b": 1.5}


def test_metrics_and_kernels(spark):
    import random

    rng = random.Random(1)
    pairs = [([rng.random() * 3 for _ in range(10)], [rng.random() * 4 for _ in range(10)]) for _ in range(6)] + [([0.0] * 3, [0.0] * 3), ([0.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x array<double>, y array<double>")
    m = {n: f(F.col("x"), F.col("y")) for n, f in metrics.METRICS.items() if n != "cosine"}
    for r in df.select("i", *(c.alias(n) for n, c in m.items())).collect():
        x, y = pairs[r.i]
        z = list(zip(x, y, strict=True))
        js = lambda a, b: a * math.log2(1 + b / a) if a else 0.0
        want = {
            "l2_squared": sum((a - b) ** 2 for a, b in z), "l1": sum(abs(a - b) for a, b in z), "linf": max(abs(a - b) for a, b in z), "l0": sum(a != b for a, b in z),
            "chi2": sum((a - b) ** 2 / (a + b) for a, b in z if a + b), "hellinger": sum(a + b - 2 * math.sqrt(a * b) for a, b in z), "js": sum(a - js(a, b) + b - js(b, a) for a, b in z),
            "kernel_chi2": sum(2 * a * b / (a + b) for a, b in z if a + b), "kernel_js": sum((js(a, b) + js(b, a)) / 2 for a, b in z),
        }
        for n, v in want.items():
            assert r[n] == pytest.approx(v, abs=1e-9), n


def test_neighbours(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((300, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(7)
    got = neighbors.top_k(df.where("id < 20"), df, 4).collect()
    for q in range(20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r.place)] == np.argsort(d)[:4].tolist()
    assert neighbors.top_k(df.limit(0), df, 2).count() == 0


def test_natural_order(spark):
    names = ["B1", "B2", "B12", "A12", "A1", "A2", "10X Radonius", "1000X Radonius Maximus", "200X Radonius", "20X Radonius"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r.s for r in df.orderBy(text.natural_key(F.col("s"))).collect()] == ["10X Radonius", "20X Radonius", "200X Radonius", "1000X Radonius Maximus", "A1", "A2", "A12", "B1", "B2", "B12"]


def test_running_max_and_modes(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 3, 2, 1])], "r int, c int, v double")
    assert [r.out for r in grid.running_max(df).orderBy("c").collect()] == [1, 2, 3, 4, 4, 4, 4]
    assert [r.v for r in grid.median_filter(df, 1).orderBy("c").collect()] == [1.5, 2, 3, 3, 3, 2, 1.5]


def test_boxes(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 2, 0.1, 0.1, 1.0, 1.0, 1.1), (0, 3, 2.0, 2.0, 1.0, 1.0, 1.0)], "img int, id int, x double, y double, w double, h double, score double")
    assert sorted(r.id for r in boxes.suppress_max(df).collect()) == sorted(r.id for r in boxes.suppress_greedy(df).collect()) == [2, 3]
    pair = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 20.0, 20.0)], "ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double")
    r = pair.select(boxes.overlap("a", "b").alias("o"), boxes.overlap("a", "b", F.lit(True)).alias("i")).first()
    assert (r.o, r.i) == (0.25, 1.0)


def test_residuals(spark):
    rows = spark.createDataFrame([(0, k, [float(k + 1)]) for k in range(3)], "g int, k int, x array<double>")
    for mu, want in (([0.0, 0.0, 0.0], [1, 2, 3]), ([0.0, 1.0, 2.0], [1, 1, 1])):
        c = spark.createDataFrame([(k, [m]) for k, m in enumerate(mu)], "k int, c array<double>")
        assert [r.v for r in encode.residuals(rows, c, "g", normalise=False).orderBy("k").collect()] == want
        assert [r.v for r in encode.residuals(rows.union(rows), c, "g", normalise=False).orderBy("k").collect()] == [2 * v for v in want]


def test_kmeans_energy_falls(spark):
    import random

    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(3 * (i % 3), 1), rng.gauss(0, 1)]) for i in range(90)], "id int, x array<double>")
    _, e = cluster.kmeans(df, spark.createDataFrame([(k, [float(k), 0.0]) for k in range(3)], "k int, c array<double>"), rounds=6)
    assert all(a >= b - 1e-9 for a, b in zip(e, e[1:], strict=False))


def test_paths_and_roots(spark):
    e = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0), (5, 0, 1.0)], "src int, dst int, w double")
    assert {r.node: r.dist for r in cluster.shortest_paths(e, 0).collect()} == {0: 0, 1: 3, 2: 1, 3: 4}
    p = spark.createDataFrame([(i, max(0, i - 1)) for i in range(20)], "node int, parent int")
    assert {r.root for r in cluster.flat_roots(p).collect()} == {0}


def test_splits_and_trees(spark):
    df = spark.createDataFrame([(0, float(x), c) for x, c in [(1, 0), (2, 0), (3, 1), (4, 1)]], "f int, x double, cls int")
    for kind in ("gini", "entropy", "twoing"):
        assert trees.best_split(df, kind).first().threshold == 2.5
    t = [(0, 0.5, 1, 0.0), (0, 0, 0, -1.0), (0, 0, 0, 1.0)]
    rows = spark.createDataFrame([([0.2],), ([0.7],)], "x array<double>")
    assert [r.v for r in rows.select(trees.boosted(F.col("x"), [t, t]).alias("v")).collect()] == [-2.0, 2.0]


def test_patch_field(spark):
    g = spark.createDataFrame([(r, c, float((r * 7 + c * 3) % 5)) for r in range(8) for c in range(8)], "r int, c int, v double")
    same = patchfield.search(g, g, 2, 1, own=True)
    assert all((r.y, r.x) == (r.ty, r.tx) or r.dist == 0 for r in same.collect())
    own = same.select("y", "x", F.col("y").alias("ty"), F.col("x").alias("tx"))
    assert {(r.r, r.c): r.v for r in patchfield.vote(own, g, 2).collect()} == {(r.r, r.c): r.v for r in g.collect()}
    assert patchfield.coherence(own).agg(F.max("n")).first()[0] == 4


def test_intervals(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate("xxyyyxz")], "s string, f int, k string")
    runs = intervals.runs(df, "s", "f", "k")
    assert [(r.start, r.end, r.kind) for r in runs.orderBy("run").collect()] == [(0, 1, "x"), (2, 4, "y"), (5, 5, "x"), (6, 6, "z")]
    assert intervals.frames(runs).count() == 7


def test_scalars(spark):
    r = spark.range(1).select(fm.sigmoid(F.lit(0.0)).alias("s"), fm.raised_cosine(0.5, F.lit(0.5)).alias("c"), fm.gaussian(F.lit(0.0)).alias("g"), colour.rotation(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2))[1][0].alias("rot"), colour.thin_plate(F.lit(0.0)).alias("t")).first()
    assert (r.s, r.c, r.g, r.rot, r.t) == pytest.approx((0.5, 0.5, 0.3989422804, 1.0, 0.0))


def test_readers(spark, tmp_path):
    (tmp_path / "k.key").write_text("2 3\n1.5 2.5 3 0.5\n 1 2 3\n4 5 6 7\n7 8\n9\n")
    got = readers.key_points(spark, str(tmp_path / "k.key")).orderBy("key").collect()
    assert [(r.y, r.x, r.descriptor) for r in got] == [(1.5, 2.5, [1, 2, 3]), (4.0, 5.0, [7, 8, 9])]
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    assert [r.v for r in readers.gray_images(spark, str(tmp_path / "a.pgm")).orderBy("r", "c").collect()] == [0, 1, 2, 3, 4, 5]
    (tmp_path / "b.txt").write_text("% bbGt version=3\nperson 1 2 3 4 0 0 0 0 0 1 0\n")
    b = readers.box_annotations(spark, str(tmp_path / "b.txt")).first()
    assert (b.lbl, b.x, b.h, b.ignore) == ("person", 1.0, 4.0, True)


def test_windows_on_a_stream(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table = {(r.start, r.event_type): r.n for r in windows.tumbling(ev, "ts", "1 hour", ["event_type"], "value").collect()}
    assert sum(table.values()) == ev.count()
    ev.write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", ["event_type"], "value")
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start, r.event_type): r.n for r in spark.table("w").collect()} == table
    assert windows.sessions(ev, "ts", "5 minutes", ["user_id"]).agg(F.sum("n")).first()[0] == ev.count()

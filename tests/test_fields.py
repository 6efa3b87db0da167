"""Relaxations, offsets, the filter language and subsets, on small literal cases."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields, improc


def small(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "r int, c int, v double")


def test_geodesic(spark):
    g = small(spark, [[0, 9, 0], [0, 9, 0], [0, 0, 0]])
    d = {(r.r, r.c): r.dist for r in fields.geodesic(g, spark.createDataFrame([(0, 0, 0.0)], "r int, c int, dist double"), 1.0).collect()}
    assert d[(2, 0)] == 2.0 and d[(0, 2)] == pytest.approx(2 + 2 * 2**0.5 - 0.0, abs=0.9) and d[(0, 2)] < 9


def test_segments(spark):
    f = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 2), (1, 0, 5, 5), (1, 1, 2, 2)], "y int, x int, ty int, tx int")
    s = {(r.y, r.x): r.segment for r in fields.segments(f).collect()}
    assert s[(0, 0)] == s[(0, 1)] == s[(1, 1)] == 0 and s[(1, 0)] == 1 << 20


def test_language(spark):
    g = small(spark, [[0, 1], [2, 4]])
    assert sorted(r.v for r in improc.process(g, "norm, rev").collect()) == [0, 0.5, 0.75, 1]
    assert sorted(r.v for r in improc.process(g, ">:1").collect()) == [0, 0, 1, 1]
    assert sorted(r.v for r in improc.process(g, "bwdist").collect()) == pytest.approx([0, 1, 1, 2**0.5])
    assert improc.process(g, "").collect() == g.collect()
    with pytest.raises(ValueError):
        improc.process(g, "sharpen")


@pytest.mark.parametrize("how,want", [("largest", [5, 6, 7, 9, 8]), ("smallest", [2, 3, 4, 1, 0]), ("first", [5, 2, 3, 6, 4]), ("last", [7, 1, 9, 8, 0])])
def test_subset(spark, how, want):
    df = spark.createDataFrame(list(enumerate([5, 2, 3, 6, 4, 7, 1, 9, 8, 0])), "i int, x int")
    assert [r.x for r in fields.subset(df, 5, how, "i", "x").orderBy("i").collect()] == want


def test_uniform_subset(spark):
    assert [r.id for r in fields.subset(spark.range(101), 3, "uniform", "id").orderBy("id").collect()] == [0, 50, 100]


def test_gain_is_clamped(spark):
    df = spark.createDataFrame([([0.0, 10.0], [0.0, 1.0]), ([1.0, 2.0], [5.0, 5.0])], "a array<double>, b array<double>")
    r = fields.gain_bias(df, "a", "b", (0.5, 2.0), (-3.0, 3.0)).select("gain", "bias").collect()
    assert [tuple(x) for x in r] == [(2.0, 3.0), (1.0, -3.0)]


def test_components_and_paths(spark):
    c = fields.components_of(spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "a int, b int"))
    assert {r.node: r.root for r in c.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    p = spark.createDataFrame([([1, 2],), ([1, 1],)], "path array<long>")
    assert {r.node: r.n for r in fields.path_counts(p, 2).collect()} == {0: 2, 1: 2, 4: 1, 3: 1}
    assert fields.cell_histograms(p.select(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("v")), 8, 9).count() == 0

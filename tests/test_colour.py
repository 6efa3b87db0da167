"""Round trips of colours and rotations."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import colour


def test_round_trips(spark):
    df = spark.createDataFrame([(0.2, 0.5, 0.9), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)], "r double, g double, b double")
    c = [F.col(n) for n in "rgb"]
    back = colour.rgb_of_xyz(*colour.xyz(*c))
    lab, luv = colour.lab(*colour.xyz(*c)), colour.luv(*colour.xyz(*c))
    for row in df.select("r", "g", "b", F.array(*back).alias("k"), F.array(*lab).alias("lab"), F.array(*luv).alias("luv")).collect():
        assert row.k == pytest.approx([row.r, row.g, row.b], abs=1e-9)
        assert row.lab[0] == pytest.approx(row.luv[0], abs=1e-6)
        if row.r == row.g == row.b:  # grays have no hue
            assert row.lab[1:] == pytest.approx([0, 0], abs=0.1) and row.luv[1:] == pytest.approx([0, 0], abs=0.1)


def test_rotations(spark):
    v = (0.3, -0.4, 1.1)
    m = colour.rotation(*(F.lit(x) for x in v))
    r = spark.range(1).select(F.array(*colour.axis_angle(m)).alias("v"), F.array(*(x for row in m for x in row)).alias("m")).first()
    assert r.v == pytest.approx(v)
    a = [r.m[3 * i : 3 * i + 3] for i in range(3)]
    for i in range(3):
        for j in range(3):
            assert sum(a[i][k] * a[j][k] for k in range(3)) == pytest.approx(float(i == j))

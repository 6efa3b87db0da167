"""Queries of round 3's findings: results on small tables, and joins that stay small on crowded data."""

import duckdb
import pytest

from gridloom.functions import frames
from gridloom.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["improc_chain"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, D)
    shown = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert shown(got.collect()) == shown(want)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("radii", [(4.0, 6.0), (0.0, 3.0), (0.0, 0.0), (0.1, 0.3)])
def test_strongest_plain(spark, ties, radii):
    """Against all pairs, with equal places, equal values, and missing or endless coordinates."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.randrange(60) * 0.1 * (10 if radii[0] > 1 else 1), rng.randrange(-40, 40) * 0.1 * (10 if radii[1] > 1 else 1), float(rng.randrange(12))) for i in range(400)]
    rows += [(400, None, 1.0, 1.0), (401, 1.0, None, 1.0), (402, 1.0, 1.0, None), (403, float("nan"), 1.0, 1.0), (404, float("inf"), 1.0, 1.0), (405, float("inf"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, y double, x double, v double")

    def beaten(a):
        for b in rows:
            if None in a or None in b:
                continue
            if abs(a[1] - b[1]) <= radii[0] and abs(a[2] - b[2]) <= radii[1] and (b[3] >= a[3] and a[0] != b[0] if ties else b[3] > a[3]):
                return True
        return False

    want = sorted(a[0] for a in rows if not beaten(a))
    assert sorted(r.id for r in frames.strongest(df, radii, ties=ties).collect()) == want


def test_strongest_crowded(spark):
    """Many points on few places: no pairs of points."""
    df = spark.range(400_000).selectExpr("id", "cast(id % 4 as double) AS y", "cast(id % 3 as double) AS x", "cast(id as double) AS v")
    assert [r.id for r in frames.strongest(df, (4.0, 6.0), most=20, ties=True).collect()] == [399_999]


def test_crowded_boxes(spark, monkeypatch):
    """Cells in several parts, and the best boxes first: as all pairs."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import boxes

    monkeypatch.setattr(boxes, "CHUNK", 16)
    monkeypatch.setattr(boxes, "PAIRS", 2000)
    monkeypatch.setattr(boxes, "FIRST", 2)
    monkeypatch.setattr(boxes, "BEST", 3)
    rng = random.Random(5)
    rows = [(i % 2, i, float(rng.randrange(-20, 60)), float(rng.randrange(50)), float(rng.randrange(40)), float(rng.randrange(5, 30)), float(rng.randrange(30))) for i in range(240)]
    df = spark.createDataFrame(rows, "img long, id long, x double, y double, w double, h double, score double")

    def over(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0

    near = [(a, b, over(a, b)) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1]]
    want = sorted((a[1], b[1]) for a, b, o in near if a[1] < b[1] and o >= 0.3)
    assert sorted((r.a, r.b) for r in boxes.own_pairs(df, 32.0, 0.3).collect()) == want
    assert sorted((r.a, r.b) for r in boxes.overlap_pairs(df, df, 32.0, 0.3, F.col("a_id") < F.col("b_id")).collect()) == want
    gone = {a[1] for a, b, o in near if o > 0.5 and (b[6] > a[6] or b[6] == a[6] and b[1] < a[1])}
    assert sorted(r.id for r in boxes.suppress_max(df).collect()) == [i for i in range(240) if i not in gone]


def test_superpixels_of_rows(spark):
    """Images that are rows: as the tables of pixels, whole and after two rounds."""
    import numpy as np

    from gridloom.operators import slic

    rng = np.random.default_rng(2)
    y, x = np.mgrid[:31, :44]
    shapes = np.stack([(np.hypot(y - 15, x - 20) < 9) * 1.0, (x > 30) * 0.7, y / 31])
    ims = {1: shapes + rng.normal(size=shapes.shape) / 8, 2: rng.normal(size=(3, 17, 9)), 3: np.ones((3, 6, 8)), 4: rng.normal(size=(3, 1, 5))}
    rows = spark.createDataFrame([(i, *im.shape[1:], im.reshape(-1).tolist()) for i, im in ims.items()], "img long, h int, w int, x array<double>")
    pixels = spark.createDataFrame([(i, r, c, im[:, r, c].tolist()) for i, im in ims.items() for r in range(im.shape[1]) for c in range(im.shape[2])], "img long, r int, c int, z array<double>")
    sizes = rows.select("img", "h", "w")
    shown = lambda df: sorted((r.img, r.r, r.c, r.label) for r in df.collect())
    assert shown(slic.of_images(rows, 5, 0.05, 6, 3)) == shown(slic.slic(pixels, sizes, 5, 0.05, 6, 3))
    tiles, regions, centres = slic.fitted(pixels, sizes, 6, 0.3, rounds=2)
    assert shown(slic.of_images(rows, 6, 0.3, 0, 2)) == shown(slic.assigned(tiles, regions, centres, 6, 0.3))


def test_merged_sessions():
    """Sessions of many keys at once, as of each key alone; few calls of the processor for many sessions."""
    import numpy as np

    from gridloom.streaming import sessions

    rng = np.random.default_rng(6)
    rows = np.zeros(300, sessions._KIND)
    rows["key"], rows["start"], rows["n"], rows["total"] = rng.integers(-3, 4, 300), rng.integers(-500, 2000, 300), 1, rng.integers(0, 9, 300)
    rows["stop"] = rows["start"] + rng.integers(0, 12, 300)
    want = [(k, *s) for k in range(-3, 4) for s in sessions.joined([tuple(r)[1:] for r in rows.tolist() if r[0] == k], 10)]
    assert sessions.merged(rows, 10).tolist() == want
    assert not len(sessions.merged(rows[:0], 10))


def test_components_without_broadcast(spark, monkeypatch):
    """No join of the loop may go through the driver, however small its tables get."""
    from gridloom.operators import fields

    plans, cut = [], fields.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(fields, "cut_lineage", seen)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in fields.components_of(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_crowded_mean_shift(spark, monkeypatch):
    """Cells in several parts: as all pairs."""
    import numpy as np

    from gridloom.operators import meanshift as ms

    monkeypatch.setattr(ms, "CHUNK", 7)
    x = np.random.default_rng(9).normal(0, 1.0, (120, 2))
    df = spark.createDataFrame([(float(a), float(b), 1 + i % 3) for i, (a, b) in enumerate(x)], "x double, y double, n long")
    got = {(r.x, r.y): (r.nx, r.ny) for r in ms.moved(df, df, 1.5, 1.0).collect()}
    n = 1 + np.arange(120) % 3
    for a in x:
        near = ((x - a) ** 2).sum(1) < 1.5**2
        assert np.allclose(got[tuple(a)], (x[near] * n[near, None]).sum(0) / n[near].sum())
    assert len(got) == 120


def test_nearest_without_shuffle(spark):
    """The words of rows as by the join; ties go to the least k."""
    from gridloom.operators import neighbors
    from gridloom.plans import inputs as I

    rows = I.vectors(spark, D)
    centres = I.centres(spark, D).unionByName(I.centres(spark, D).selectExpr("k + 100 AS k", "c"))
    shown = lambda df: sorted((r.id, r.k, r.distance) for r in df.select("id", "k", "distance").collect())
    got = neighbors.with_nearest(rows, centres)
    assert shown(got) == shown(neighbors.nearest_centre(rows, centres)) and "Exchange hashpartitioning(id" not in got._jdf.queryExecution().toString()

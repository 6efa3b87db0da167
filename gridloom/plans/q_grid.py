"""Queries: windows on grids, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math as fm
from ..operators import boxes, grid
from . import inputs as I
from .registry import query

r6 = lambda c: F.round(c, 6)
_V = f"WITH {I.VEC}, g AS (SELECT id AS r, c, v FROM vec)"
_G = f"WITH {I.COUNT_GRID}"


@query("cummax", f"{_V} SELECT r, c, round(max(v) OVER (PARTITION BY r ORDER BY c), 6) AS out FROM g")
def cummax(spark, d):
    return grid.running_max(I.cells(spark, d)).select("r", "c", r6("out").alias("out"))


@query("gradient", f"""{_G} SELECT r, c, round((coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / (CASE WHEN c IN (0, 31) THEN 1 ELSE 2 END), 6) AS gx,
round((coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / (CASE WHEN r IN (0, 23) THEN 1 ELSE 2 END), 6) AS gy FROM grid WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)""")
def gradient(spark, d):
    return grid.gradient(I.count_grid(spark, d)).select("r", "c", r6("gx").alias("gx"), r6("gy").alias("gy"))


@query("gradient_forward", f"{_G} SELECT r, c, round(coalesce(lead(v) OVER (PARTITION BY r ORDER BY c) - v, 0), 6) AS gx, round(coalesce(lead(v) OVER (PARTITION BY c ORDER BY r) - v, 0), 6) AS gy FROM grid")
def gradient_forward(spark, d):
    return grid.forward_difference(I.count_grid(spark, d)).select("r", "c", r6("gx").alias("gx"), r6("gy").alias("gy"))


_MIRROR = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


def _mirrored(weights: str) -> str:
    """weights: rows (i, w) of a separable stencil."""
    return f"{_G}, w AS (SELECT i, w::DOUBLE AS w FROM ({weights}) t(i, w)) SELECT a.r, a.c, round(sum(b.v * x.w * y.w), 6) AS v FROM grid a, w x, w y JOIN grid b ON b.r = {_MIRROR('a.r + x.i', 24)} AND b.c = {_MIRROR('a.c + y.i', 32)} GROUP BY 1, 2"


@query("box_filter", _mirrored("SELECT i, 0.2 FROM range(-2, 3) s(i)"))
def box_filter(spark, d):
    return grid.box_filter(I.count_grid(spark, d), 2).select("r", "c", r6("v").alias("v"))


@query("box_filter_sampled", f"SELECT CAST((r - 1) // 3 AS INT) AS r, CAST((c - 1) // 3 AS INT) AS c, v FROM ({_mirrored('SELECT i, 1 / 7.0::DOUBLE FROM range(-3, 4) s(i)')}) WHERE r % 3 = 1 AND c % 3 = 1 AND c < 30")
def box_filter_sampled(spark, d):
    return grid.sampled(grid.box_filter(I.count_grid(spark, d), 3), 24, 32, 3).select("r", "c", r6("v").alias("v"))


@query("triangle_filter_wide", _mirrored("SELECT i, (4 - abs(i)) / 16.0::DOUBLE FROM range(-3, 4) s(i)"))
def triangle_filter_wide(spark, d):
    return grid.triangle_filter(I.count_grid(spark, d), 3).select("r", "c", r6("v").alias("v"))


@query("max_filter", f"{_G} SELECT a.r, a.c, max(b.v) AS v FROM grid a JOIN grid b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2")
def max_filter(spark, d):
    return grid.max_filter(I.count_grid(spark, d), 1)


@query("tri_filter", f"""{_G} SELECT a.r, a.c, round(sum(b.v * (2 - abs(i)) * (2 - abs(j)) / 16.0::DOUBLE), 6) AS v FROM grid a, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)
JOIN grid b ON b.r = least(23, greatest(0, a.r + i)) AND b.c = least(31, greatest(0, a.c + j)) GROUP BY 1, 2""")
def tri_filter(spark, d):
    return grid.triangle_filter(I.count_grid(spark, d), 1).select("r", "c", r6("v").alias("v"))


@query("gauss_filter", f"""{_G}, w AS (SELECT i, exp(-i * i / 2.0::DOUBLE) / sum(exp(-i * i / 2.0::DOUBLE)) OVER () AS w FROM (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) t(i))
SELECT a.r, a.c, round(sum(b.v * x.w * y.w), 6) AS v FROM grid a, w x, w y JOIN grid b ON b.r = least(23, greatest(0, a.r + x.i)) AND b.c = least(31, greatest(0, a.c + y.i)) GROUP BY 1, 2""")
def gauss_filter(spark, d):
    return grid.weighted_filter(I.count_grid(spark, d), grid.gaussian_weights(1.0)).select("r", "c", r6("v").alias("v"))


@query("median_filter", f"{_G} SELECT r, c, median(v) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM grid")
def median_filter(spark, d):
    return grid.median_filter(I.count_grid(spark, d), 2)


@query("mode_filter", f"""{_G}, n AS (SELECT a.r, a.c, b.v, count(*) AS n FROM grid a JOIN grid b ON a.r = b.r AND abs(a.c - b.c) <= 2 GROUP BY ALL)
SELECT r, c, arg_min(v, (-n, v)) AS v FROM n GROUP BY r, c""")
def mode_filter(spark, d):
    return grid.mode_filter(I.count_grid(spark, d), 2)


@query("integral_image", f"{_G}, a AS (SELECT r, c, sum(v) OVER (PARTITION BY r ORDER BY c) AS v FROM grid) SELECT r, c, sum(v) OVER (PARTITION BY c ORDER BY r) AS v FROM a")
def integral_image(spark, d):
    return grid.integral(I.count_grid(spark, d))


_RECT = [(1, 2, 3, 9, 12), (2, 0, 0, 23, 31), (3, 5, 0, 5, 31)]


@query("integral_hist_sample", f"""{_G}, q(id, r0, c0, r1, c1) AS (VALUES {', '.join(map(str, _RECT))})
SELECT id, CAST(v % 4 AS INT) AS lbl, count(*) AS n FROM grid JOIN q ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 WHERE v % 4 <> 0 GROUP BY 1, 2""")
def integral_hist_sample(spark, d):
    labels = I.count_grid(spark, d).select("r", "c", (F.col("v") % 4).cast("int").alias("lbl"))
    rects = spark.createDataFrame(_RECT, "id int, r0 int, c0 int, r1 int, c1 int")
    return grid.sample_histogram(grid.integral_histogram(labels, range(4)), rects).where("n > 0")


@query("local_max", f"""{_G} SELECT a.r, a.c, a.v FROM grid a JOIN grid b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c)
GROUP BY ALL HAVING count(*) = 8 AND a.v > max(b.v)""")
def local_max(spark, d):
    return grid.local_maxima(I.count_grid(spark, d))


@query("distance_transform", f"{_G} SELECT a.r, a.c, min(b.v * 4 + (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))::DOUBLE AS v FROM grid a, grid b GROUP BY 1, 2")
def distance_transform(spark, d):
    return grid.squared_distance_transform(I.count_grid(spark, d).withColumn("v", F.col("v") * 4))


@query("downsample", f"{_G} SELECT CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, v FROM grid WHERE r % 2 = 0 AND c % 2 = 0")
def downsample(spark, d):
    return grid.downsample(I.count_grid(spark, d))


@query("segment_mean", f"{_G} SELECT r, c, round(avg(v) OVER (PARTITION BY (r // 6) * 4 + c // 8), 6) AS out FROM grid")
def segment_mean(spark, d):
    g = I.count_grid(spark, d).withColumn("lbl", F.floor(F.col("r") / 6) * 4 + F.floor(F.col("c") / 8))
    return grid.segment_mean(g, "lbl").select("r", "c", r6("out").alias("out"))


@query("array_crop", f"""{_G} SELECT CAST(i // 40 AS INT) AS r, CAST(i % 40 AS INT) AS c, coalesce(v, -1) AS v FROM range(400) t(i) LEFT JOIN grid ON r = i // 40 + 20 AND c = i % 40 - 4""")
def array_crop(spark, d):
    return grid.cropped(I.count_grid(spark, d), 20, 29, -4, 35, -1.0)


@query("index_column_major", f"{_G} SELECT r, c, r + c * 24 + 1 AS idx FROM grid")
def index_column_major(spark, d):
    return I.count_grid(spark, d).select("r", "c", grid.column_major(F.col("r"), F.col("c"), 24).alias("idx"))


_BITS = " + ".join(f"CASE WHEN max(b.v) FILTER (WHERE b.r = a.r + {dr} AND b.c = a.c + {dc}) > a.v THEN {1 << k} ELSE 0 END" for k, (dr, dc) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]))


@query("lbp_hist", f"""{_G}, code AS (SELECT a.r, a.c, {_BITS} AS code FROM grid a JOIN grid b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c, a.v HAVING count(*) = 9),
bits AS (SELECT code, k, (code >> k) & 1 AS b, (code >> ((k + 7) % 8)) & 1 AS before FROM (SELECT DISTINCT code FROM code), range(8) t(k)),
pat AS (SELECT code, sum(b) AS ones, count(*) FILTER (WHERE b = 1 AND before = 0) AS turns, min(k) FILTER (WHERE b = 1 AND before = 0) AS start FROM bits GROUP BY code)
SELECT CAST(CASE WHEN code IN (0, 255) THEN 56 WHEN turns = 1 THEN (ones - 1) * 8 + start ELSE 57 END AS INT) AS bin, count(*) AS n FROM code JOIN pat USING (code) GROUP BY 1""")
def lbp_hist(spark, d):
    return grid.binary_patterns(I.count_grid(spark, d)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("special_functions", """SELECT event_id AS id, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS g, round(-x * exp(-x * x / 2) / sqrt(2 * pi()), 6) + 0.0 AS dg, round((x * x - 1) * exp(-x * x / 2) / sqrt(2 * pi()), 6) + 0.0 AS ddg,
round(1 / (1 + exp(-x)), 6) AS s, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS ds FROM (SELECT event_id, value / 50 - 1 AS x FROM events)""")
def special_functions(spark, d):
    x = F.col("x")
    e = I.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 50 - 1).alias("x"))
    return e.select("id", r6(fm.gaussian(x)).alias("g"), (r6(fm.d_gaussian(x)) + 0.0).alias("dg"), (r6(fm.dd_gaussian(x)) + 0.0).alias("ddg"), r6(fm.sigmoid(x)).alias("s"), r6(fm.d_sigmoid(x)).alias("ds"))


# --- boxes

_IOU = """greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"""
_OV = f"({_IOU}) / (a.w * a.h + b.w * b.h - {_IOU})"


@query("box_iou", f"WITH {I.BOXES} SELECT a.img, a.id AS a, b.id AS b, round({_OV}, 6) AS overlap FROM box a JOIN box b USING (img) WHERE a.id < b.id AND {_OV} >= 0.3")
def box_iou(spark, d):
    return boxes.own_pairs(I.boxes(spark, d), 32.0, 0.3).select("img", "a", "b", r6("overlap").alias("overlap"))


@query("box_nms_max", f"WITH {I.BOXES} SELECT a.img, a.id FROM box a WHERE NOT EXISTS (SELECT 1 FROM box b WHERE a.img = b.img AND a.id <> b.id AND (b.score > a.score OR b.score = a.score AND b.id < a.id) AND {_OV} > 0.5)")
def box_nms_max(spark, d):
    return boxes.suppress_max(I.boxes(spark, d)).select("img", "id")


@query("box_nms_greedy", f"""WITH RECURSIVE {I.BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, id) AS k FROM box),
hit AS (SELECT a.img, a.k AS a, list(b.k) AS by_ FROM o a JOIN o b ON a.img = b.img AND b.k < a.k AND {_OV} > 0.5 GROUP BY 1, 2),
s(img, k, kept) AS (SELECT img, 1::BIGINT, [1::BIGINT] FROM o WHERE k = 1 UNION ALL
SELECT s.img, s.k + 1, CASE WHEN hit.by_ IS NOT NULL AND len(list_intersect(hit.by_, s.kept)) > 0 THEN s.kept ELSE list_append(s.kept, s.k + 1) END FROM s JOIN o ON o.img = s.img AND o.k = s.k + 1 LEFT JOIN hit ON hit.img = s.img AND hit.a = s.k + 1),
f AS (SELECT img, arg_max(kept, k) AS kept FROM s GROUP BY img)
SELECT o.img, o.id FROM o JOIN f USING (img) WHERE list_contains(kept, o.k)""")
def box_nms_greedy(spark, d):
    return boxes.suppress_greedy(I.boxes(spark, d)).select("img", "id")


@query("box_resize", f"WITH {I.BOXES} SELECT id, x + (w - w * 0.5) / 2 AS x, y + (h - h * 2) / 2 AS y, w * 0.5 AS w, h * 2.0 AS h FROM box")
def box_resize(spark, d):
    n = boxes.resized(2.0, 0.5)
    return I.boxes(spark, d).select("id", *(n[k].alias(k) for k in ("x", "y", "w", "h")))


@query("box_squarify", f"WITH {I.BOXES} SELECT id, x + (w - greatest(w, h)) / 2 AS x, y + (h - greatest(w, h)) / 2 AS y, greatest(w, h) AS w, greatest(w, h) AS h FROM box")
def box_squarify(spark, d):
    n = boxes.squared()
    return I.boxes(spark, d).select("id", *(n[k].alias(k) for k in ("x", "y", "w", "h")))


@query("box_area_centre", f"WITH {I.BOXES} SELECT id, w * h AS area, x + w / 2 AS cx, y + h / 2 AS cy FROM box")
def box_area_centre(spark, d):
    cx, cy = boxes.centre()
    return I.boxes(spark, d).select("id", boxes.area().alias("area"), cx.alias("cx"), cy.alias("cy"))


@query("box_union_intersect", f"""WITH {I.BOXES}, n AS (SELECT img, id, x, y, w, h, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(w) OVER o AS w2, lead(h) OVER o AS h2 FROM box WINDOW o AS (PARTITION BY img ORDER BY id)),
i AS (SELECT *, least(x + w, x2 + w2) - greatest(x, x2) AS iw, least(y + h, y2 + h2) - greatest(y, y2) AS ih FROM n WHERE x2 IS NOT NULL)
SELECT id, CASE WHEN iw >= 0 AND ih >= 0 THEN iw ELSE 0 END AS iw, CASE WHEN iw >= 0 AND ih >= 0 THEN ih ELSE 0 END AS ih, greatest(x + w, x2 + w2) - least(x, x2) AS uw, greatest(y + h, y2 + h2) - least(y, y2) AS uh FROM i""")
def box_union_intersect(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("img").orderBy("id")
    b = I.boxes(spark, d).select("id", *(F.col(n).alias(f"a_{n}") for n in ("x", "y", "w", "h")), *(F.lead(n).over(w).alias(f"b_{n}") for n in ("x", "y", "w", "h"))).where("b_x IS NOT NULL")
    i, u = boxes.intersection("a_", "b_"), boxes.hull("a_", "b_")
    return b.select("id", i["w"].alias("iw"), i["h"].alias("ih"), u["w"].alias("uw"), u["h"].alias("uh"))


@query("box_match")
def box_match(spark, d):
    b = I.boxes(spark, d)
    truth = b.where(F.col("id") % 2 == 0).withColumn("ignore", F.col("id") % 10 == 0)
    return boxes.match(truth, b.where(F.col("id") % 2 == 1), 0.3)

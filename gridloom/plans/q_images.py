"""Queries: gradient histograms and lattices of descriptors of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, dsift, encode, hog
from ..operators.neighbors import with_nearest
from . import inputs as I
from .registry import query

r6 = lambda c: F.round(c, 6)

_GRAD = f"""{I.IMAGES}, gr AS (SELECT img, y, x, lead(v) OVER r - lag(v) OVER r AS gx, lead(v) OVER c - lag(v) OVER c AS gy FROM px WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
po AS (SELECT img, y, x, sqrt(gx * gx + gy * gy) AS m, CAST(floor(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END * 9 / pi() + 0.5) AS INT) % 18 AS o FROM gr WHERE gx IS NOT NULL AND gy IS NOT NULL),
hy AS (SELECT img, y, x, m, o, (y + 0.5::DOUBLE) / 8 - 0.5 AS hy, (x + 0.5::DOUBLE) / 8 - 0.5 AS hx FROM po),
co AS (SELECT img, o, CAST(floor(hy) AS INT) + dy AS cy, CAST(floor(hx) AS INT) + dx AS cx, m * (CASE dy WHEN 0 THEN 1 - (hy - floor(hy)) ELSE hy - floor(hy) END) * (CASE dx WHEN 0 THEN 1 - (hx - floor(hx)) ELSE hx - floor(hx) END) AS m FROM hy, range(2) a(dy), range(2) b(dx)),
hi AS (SELECT img, cy, cx, o, sum(m) AS h FROM co WHERE cy BETWEEN 0 AND 3 AND cx BETWEEN 0 AND 3 GROUP BY ALL),
fu AS (SELECT img, cy, cx, o, coalesce(h, 0.0)::DOUBLE AS h FROM img CROSS JOIN range(4) a(cy) CROSS JOIN range(4) b(cx) CROSS JOIN range(18) c(o) LEFT JOIN hi USING (img, cy, cx, o)),
fl AS (SELECT a.img, a.cy, a.cx, a.o, a.h + b.h AS h FROM fu a JOIN fu b ON a.img = b.img AND a.cy = b.cy AND a.cx = b.cx AND b.o = a.o + 9),
no AS (SELECT img, cy, cx, sum(h * h) AS n FROM fl GROUP BY ALL),
fa AS (SELECT c.img, c.cy, c.cx, ay * 2 + ax AS blk, 1 / sqrt(sum(n.n) + 1e-4) AS f FROM (SELECT DISTINCT img, cy, cx FROM no) c CROSS JOIN range(2) a(ay) CROSS JOIN range(2) b(ax) CROSS JOIN range(2) d(ey) CROSS JOIN range(2) e(ex)
JOIN no n ON n.img = c.img AND n.cy = greatest(0, least(3, c.cy + ay - 1 + ey)) AND n.cx = greatest(0, least(3, c.cx + ax - 1 + ex)) GROUP BY ALL),
di AS (SELECT img, cy, cx, o, blk, least(0.2, f * h) AS v FROM fu JOIN fa USING (img, cy, cx)), un AS (SELECT img, cy, cx, o, blk, least(0.2, f * h) AS v FROM fl JOIN fa USING (img, cy, cx))"""


def _long(made):
    return made.select(F.col("img").cast("bigint").alias("img"), "y", "x", F.posexplode("f").alias("d", "f")).select("img", "y", "x", "d", (r6("f") + 0.0).alias("f"))


_OUT = "SELECT img, CAST(cy AS INT) AS y, CAST(cx AS INT) AS x, CAST(d AS INT) AS d, round(f, 6) + 0.0 AS f"


@query("hog_uoctti", f"""WITH {_GRAD} {_OUT} FROM (SELECT img, cy, cx, o AS d, sum(v) / 2 AS f FROM di GROUP BY ALL UNION ALL SELECT img, cy, cx, 18 + o, sum(v) / 2 FROM un GROUP BY ALL
UNION ALL SELECT img, cy, cx, 27 + blk, sum(v) / sqrt(18) FROM un GROUP BY ALL)""")
def hog_uoctti(spark, d):
    return _long(hog.hog(I.images(spark, d)))


@query("hog_dalal", f"WITH {_GRAD} {_OUT} FROM (SELECT img, cy, cx, blk * 9 + o AS d, v AS f FROM un)")
def hog_dalal(spark, d):
    return _long(hog.hog(I.images(spark, d), variant="dalal"))


def _pixels(spark, d):
    return I.images(spark, d).select("img", F.lit(0).alias("ch"), F.posexplode("x").alias("p", "v")).select("img", "ch", F.floor(F.col("p") / 32).cast("int").alias("r"), (F.col("p") % 32).alias("c"), "v")


@query("hog_tiles", f"WITH {_GRAD} {_OUT} FROM (SELECT img, cy, cx, blk * 9 + o AS d, v AS f FROM un)")
def hog_tiles(spark, d):
    sizes = I.images(spark, d).select("img", "h", "w")
    return _long(hog.hog_tiles(_pixels(spark, d), sizes, variant="dalal", tile=2))


_FHOG = f"""{I.IMAGES}, gr AS (SELECT img, y, x, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN x IN (0, 31) THEN 1 ELSE 2 END AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN y IN (0, 31) THEN 1 ELSE 2 END AS gy
FROM px WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
hy AS (SELECT img, greatest(sqrt(gx * gx + gy * gy), 1e-10) / 64 AS m, CAST(floor(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END * 9 / pi() + 0.5) AS INT) % 18 AS o, (y + 0.5::DOUBLE) / 8 - 0.5 AS hy, (x + 0.5::DOUBLE) / 8 - 0.5 AS hx FROM gr),
co AS (SELECT img, o, CAST(floor(hy) AS INT) + dy AS cy, CAST(floor(hx) AS INT) + dx AS cx, m * (CASE dy WHEN 0 THEN 1 - (hy - floor(hy)) ELSE hy - floor(hy) END) * (CASE dx WHEN 0 THEN 1 - (hx - floor(hx)) ELSE hx - floor(hx) END) AS m FROM hy, range(2) a(dy), range(2) b(dx)),
hi AS (SELECT img, cy, cx, o, sum(m * (CASE WHEN cy IN (0, 3) THEN 8 / 7.0::DOUBLE ELSE 1 END) * (CASE WHEN cx IN (0, 3) THEN 8 / 7.0::DOUBLE ELSE 1 END)) AS h FROM co WHERE cy BETWEEN 0 AND 3 AND cx BETWEEN 0 AND 3 GROUP BY ALL),
fu AS (SELECT img, cy, cx, o, coalesce(h, 0.0)::DOUBLE AS h FROM img CROSS JOIN range(4) a(cy) CROSS JOIN range(4) b(cx) CROSS JOIN range(18) c(o) LEFT JOIN hi USING (img, cy, cx, o)),
fl AS (SELECT a.img, a.cy, a.cx, a.o, a.h + b.h AS h FROM fu a JOIN fu b ON a.img = b.img AND a.cy = b.cy AND a.cx = b.cx AND b.o = a.o + 9),
no AS (SELECT img, cy, cx, sum(h * h) AS n FROM fl GROUP BY ALL),
bl AS (SELECT img, ky, kx, 1 / sqrt(sum(n) + 1e-4 / 4 / 4096) AS f FROM range(3) a(ky) CROSS JOIN range(3) b(kx) JOIN no ON cy IN (ky, ky + 1) AND cx IN (kx, kx + 1) GROUP BY ALL),
fa AS (SELECT c.img, c.cy, c.cx, 3 - (2 * ex + ey) AS blk, f FROM (SELECT DISTINCT img, cy, cx FROM no) c CROSS JOIN range(2) a(ey) CROSS JOIN range(2) b(ex) JOIN bl ON bl.img = c.img AND ky = greatest(0, least(2, cy - 1 + ey)) AND kx = greatest(0, least(2, cx - 1 + ex))),
di AS (SELECT img, cy, cx, o, blk, least(0.2, f * h) AS v FROM fu JOIN fa USING (img, cy, cx)), un AS (SELECT img, cy, cx, o, blk, least(0.2, f * h) AS v FROM fl JOIN fa USING (img, cy, cx))"""


@query("fhog", f"""WITH {_FHOG} {_OUT} FROM (SELECT img, cy, cx, o AS d, sum(v) / 2 AS f FROM di GROUP BY ALL UNION ALL SELECT img, cy, cx, 18 + o, sum(v) / 2 FROM un GROUP BY ALL
UNION ALL SELECT img, cy, cx, 27 + blk, sum(v) * 0.2357 FROM di GROUP BY ALL UNION ALL SELECT DISTINCT img, cy, cx, 31, 0.0 FROM no)""")
def fhog(spark, d):
    return _long(hog.fhog(I.images(spark, d)))


def _dense(size: int, step: int, window: float, flat: bool) -> str:
    gauss = f"exp(-0.5 * pow((o + {size} * (b - 1.5)) / ({size} * {window}::DOUBLE), 2))"
    return f"""{I.IMAGES}, gr AS (SELECT img, y, x, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN x IN (0, 31) THEN 1 ELSE 2 END AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN y IN (0, 31) THEN 1 ELSE 2 END AS gy
FROM px WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
po AS (SELECT img, y, x, sqrt(gx * gx + gy * gy) AS m, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END * 4 / pi() AS a FROM gr),
pl AS (SELECT img, y, x, (CAST(floor(a) AS INT) + e) % 8 AS t, m * (CASE e WHEN 0 THEN 1 - (a - floor(a)) ELSE a - floor(a) END) AS m FROM po, range(2) q(e)),
k AS (SELECT b, o, (1 - abs(o) / {size}.0::DOUBLE) * {f"avg({gauss}) OVER (PARTITION BY b)" if flat else gauss} AS k FROM range(4) p(b), range({1 - size}, {size}) q(o)),
s AS (SELECT f * {step} AS f, b, o, k, greatest(0, least(31, f * {step} + b * {size} + o)) AS at FROM range({(32 - 3 * size - 1) // step + 1}) z(f), k),
c1 AS (SELECT img, y, s.f AS fx, s.b AS ax, t, sum(m * k) AS m FROM pl JOIN s ON x = s.at GROUP BY ALL),
c2 AS (SELECT img, s.f AS fy, s.b AS ay, fx, ax, t, sum(m * k) AS v FROM c1 JOIN s ON y = s.at GROUP BY ALL),
nn AS (SELECT *, sum(v) OVER p / {(3 * size + 1) ** 2} AS norm, least(0.2, v / (sqrt(sum(v * v) OVER p) + 1.19209290e-07)) AS w FROM c2 WINDOW p AS (PARTITION BY img, fy, fx)),
ds AS (SELECT img, fx + {1.5 * size}::DOUBLE AS x, fy + {1.5 * size}::DOUBLE AS y, norm, (ay * 4 + ax) * 8 + t AS d, w / (sqrt(sum(w * w) OVER (PARTITION BY img, fy, fx)) + 1.19209290e-07) AS v FROM nn)"""


_DENSE_OUT = "SELECT img, x, y, round(norm, 6) AS norm, CAST(d AS INT) AS d, round(v, 6) AS v FROM ds WHERE round(v, 6) > 0"


def _lattice(made):
    long = made.select(F.col("img").cast("bigint").alias("img"), "x", "y", r6("norm").alias("norm"), F.posexplode("d").alias("d", "v"))
    return long.withColumn("v", r6("v")).where("v > 0")


@query("dense_sift", f"WITH {_dense(4, 8, 2.0, False)} {_DENSE_OUT}")
def dense_sift(spark, d):
    return _lattice(dsift.dsift(I.images(spark, d), size=4, step=8))


@query("dense_sift_flat", f"WITH {_dense(3, 6, 1.5, True)} {_DENSE_OUT}")
def dense_sift_flat(spark, d):
    return _lattice(dsift.dsift(I.images(spark, d), size=3, step=6, window_size=1.5, flat=True))


# no SQL: four scales of smoothed images; tests hold them against plain sums
@query("phow_vlad")
def phow_vlad(spark, d):
    """Descriptors at several scales, summed up for each image by the words they are nearest to."""
    found = dsift.phow(I.images(spark, d), sizes=(3, 4, 5), step=4)
    rows = found.select(F.concat_ws(",", "img", "x", "y", "size").alias("id"), "img", F.col("d").alias("x"))
    centres = cluster.means(rows.withColumn("k", F.col("img") % 4), "k")
    return encode.residuals(with_nearest(rows, centres).select("img", "k", "x"), centres, "img").select("img", "k", "i", r6("v").alias("v"))

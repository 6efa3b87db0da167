"""Queries: relaxations, segments, offsets, filter language, subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, improc, patchfield
from . import inputs as I
from .q_models import _FIELD, _field
from .registry import query

r6 = lambda c: F.round(c, 6)
_G = f"WITH {I.COUNT_GRID}"


@query("geodesic_distance", f"""WITH RECURSIVE {I.COUNT_GRID}, e AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) + 0.25 * (a.v - b.v) * (a.v - b.v)) AS w
FROM grid a JOIN grid b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c)),
w(r, c, d, n) AS (SELECT 0, 0, 0.0::DOUBLE, 0 UNION ALL SELECT r2, c2, min(d + e.w), n + 1 FROM w JOIN e USING (r, c) WHERE n < 60 GROUP BY r2, c2, n + 1)
SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(min(d), 6) AS dist FROM w GROUP BY 1, 2""")
def geodesic_distance(spark, d):
    start = spark.createDataFrame([(0, 0, 0.0)], "r int, c int, dist double")
    return fields.geodesic(I.count_grid(spark, d), start, 0.5).select("r", "c", r6("dist").alias("dist"))


@query("field_segments", f"""WITH RECURSIVE {_FIELD}, p AS (SELECT y, x, ty - y AS dy, tx - x AS dx, CAST(y AS BIGINT) * 1048576 + x AS me FROM fld),
l AS (SELECT a.me AS a, b.me AS b FROM p a JOIN p b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.dy = b.dy AND a.dx = b.dx),
w(a, b) AS (SELECT me, me FROM p UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b)
SELECT y, x, min(w.b) AS segment FROM p JOIN w ON w.a = p.me GROUP BY 1, 2""")
def field_segments(spark, d):
    return fields.segments(_field(spark, d)[1])


@query("lattice_density", f"""WITH {_FIELD}, n AS (SELECT ty - y AS dy, tx - x AS dx, count(*) AS n FROM fld GROUP BY 1, 2),
e AS (SELECT a.dy, a.dx, sum(b.n * exp(-((a.dy - b.dy) * (a.dy - b.dy) + (a.dx - b.dx) * (a.dx - b.dx)) / 2.0::DOUBLE)) AS e FROM n a JOIN n b ON abs(a.dy - b.dy) <= 3 AND abs(a.dx - b.dx) <= 3 GROUP BY 1, 2)
SELECT dy, dx, round(e - avg(e) OVER (), 6) AS e FROM e""")
def lattice_density(spark, d):
    return fields.offset_density(_field(spark, d)[1], 1.0, 3).select("dy", "dx", r6("e").alias("e"))


@query("gain_bias", f"""WITH {_FIELD}, p AS (SELECT y, x, avg(s.v) AS ma, avg(t.v) AS mb, stddev_pop(s.v) AS da, stddev_pop(t.v) AS db FROM fld, range(9) k(k) JOIN grid s ON s.r = y + k // 3 AND s.c = x + k % 3 JOIN grid t ON t.r = ty + k // 3 AND t.c = tx + k % 3 GROUP BY 1, 2),
g AS (SELECT *, least(1.5, greatest(0.5, CASE WHEN db = 0 THEN 1 ELSE da / db END))::DOUBLE AS gain FROM p)
SELECT y, x, round(gain, 6) AS gain, round(least(50, greatest(-50, ma - gain * mb))::DOUBLE, 6) + 0.0 AS bias FROM g""")
def gain_bias(spark, d):
    g, f = _field(spark, d)
    p = patchfield.patches(g, 3)
    both = f.join(p, ["y", "x"]).join(p.select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("patch").alias("to")), ["ty", "tx"])
    return fields.gain_bias(both, "patch", "to", (0.5, 1.5), (-50.0, 50.0)).select("y", "x", r6("gain").alias("gain"), (r6("bias") + 0.0).alias("bias"))


@query("hog_cells", f"""{_G}, g AS (SELECT r, c, (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / (CASE WHEN c IN (0, 31) THEN 1 ELSE 2 END) AS gx, (coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / (CASE WHEN r IN (0, 23) THEN 1 ELSE 2 END) AS gy FROM grid WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)),
t AS (SELECT *, atan2(gy, gx) / pi() AS a FROM g WHERE gx <> 0 OR gy <> 0)
SELECT CAST(r // 8 AS INT) AS cr, CAST(c // 8 AS INT) AS cc, CAST(floor((a - floor(a)) * 9 + 1e-9) AS INT) % 9 AS bin, round(sum(sqrt(gx * gx + gy * gy)), 6) AS m FROM t GROUP BY 1, 2, 3""")
def hog_cells(spark, d):
    return fields.cell_histograms(I.count_grid(spark, d), 8, 9).select("cr", "cc", "bin", r6("m").alias("m"))


@query("colsubset_largest", "SELECT event_id AS id, value AS v FROM events ORDER BY value DESC, event_id LIMIT 25")
def colsubset_largest(spark, d):
    return fields.subset(I.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v")), 25, "largest", "id", "v")


@query("colsubset_uniform", "WITH n AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS t FROM events) SELECT DISTINCT id FROM n, range(11) g(j) WHERE k = CAST(round_even((t - 1) * j / 10.0, 0) AS BIGINT) + 1")
def colsubset_uniform(spark, d):
    return fields.subset(I.table(spark, d, "events").select(F.col("event_id").alias("id")), 11, "uniform", "id")


@query("tree_path_hist", "WITH p AS (SELECT 1 + l_linenumber % 3 AS a, 1 + l_partkey % 3 AS b FROM lineitem) SELECT 0::BIGINT AS node, count(*) AS n FROM p UNION ALL SELECT a::BIGINT, count(*) FROM p GROUP BY 1 UNION ALL SELECT (a * 3 + b)::BIGINT, count(*) FROM p GROUP BY 1")
def tree_path_hist(spark, d):
    p = I.table(spark, d, "lineitem").select(F.array((1 + F.col("l_linenumber") % 3).cast("long"), (1 + F.col("l_partkey") % 3).cast("long")).alias("path"))
    return fields.path_counts(p, 3)


@query("improc_chain", f"""{_G}, n AS (SELECT r, c, 1 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS v FROM grid), a AS (SELECT r, c, avg(v) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM n),
b AS (SELECT r, c, avg(v) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM a) SELECT r, c, round(CASE WHEN v * 2 >= 0.9 THEN v * 2 ELSE 0 END, 6) AS v FROM b""")
def improc_chain(spark, d):
    return improc.process(I.count_grid(spark, d), "norm, rev, box:1, *:2, t+:0.9").select("r", "c", r6("v").alias("v"))


@query("connected_components", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part UNION SELECT p_partkey + 1 + p_size % 3, p_partkey FROM part),
w(node, root) USING KEY (node) AS (SELECT a, min(a) FROM e GROUP BY a UNION SELECT e.b, min(w.root) FROM w JOIN e ON e.a = w.node JOIN recurring.w AS o ON o.node = e.b WHERE w.root < o.root GROUP BY e.b)
SELECT node, root FROM w""")
def connected_components(spark, d):
    k = F.col("p_partkey")
    return fields.components_of(I.table(spark, d, "part").select(k.alias("a"), (k + 1 + F.col("p_size") % 3).alias("b")))

"""Queries: padding, resampling, warps, stencils, blocks, frames, lists of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames
from ..operators import warps
from . import inputs as I
from .registry import query

r6 = lambda c: F.round(c, 6)
H, W = 24, 32
_G = f"WITH {I.COUNT_GRID}"
_RC = "CAST(r AS INT) AS r, CAST(c AS INT) AS c"


def _grid(spark, d):
    return I.count_grid(spark, d)


def _out(df):
    return df.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), r6("v").alias("v"))


_PAD = "o AS (SELECT i // 37 AS r, i % 37 AS c FROM range(30 * 37) t(i))"  # 2 above, 4 below, 3 left, 2 right


def _pad_sql(sr: str, sc: str, value: str = "v") -> str:
    return f"{_G}, {_PAD} SELECT CAST(o.r AS INT) AS r, CAST(o.c AS INT) AS c, round({value}, 6) AS v FROM o LEFT JOIN grid g ON g.r = {sr} AND g.c = {sc}"


def _mirror(i: str, n: int) -> str:
    return f"(CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} >= {n} THEN {2 * n} - 1 - {i} ELSE {i} END)"


@query("pad_constant", _pad_sql("o.r - 2", "o.c - 3", "coalesce(v, 7)"))
def pad_constant(spark, d):
    return _out(warps.padded(_grid(spark, d), H, W, (2, 4, 3, 2), "constant", 7.0))


@query("pad_replicate", _pad_sql("least(23, greatest(0, o.r - 2))", "least(31, greatest(0, o.c - 3))"))
def pad_replicate(spark, d):
    return _out(warps.padded(_grid(spark, d), H, W, (2, 4, 3, 2), "replicate"))


@query("pad_symmetric", _pad_sql(_mirror("(o.r - 2)", 24), _mirror("(o.c - 3)", 32)))
def pad_symmetric(spark, d):
    return _out(warps.padded(_grid(spark, d), H, W, (2, 4, 3, 2), "symmetric"))


@query("pad_circular", _pad_sql("(o.r - 2 + 24) % 24", "(o.c - 3 + 32) % 32"))
def pad_circular(spark, d):
    return _out(warps.padded(_grid(spark, d), H, W, (2, 4, 3, 2), "circular"))


@query("to_size", f"{_G} SELECT CAST(i // 36 AS INT) AS r, CAST(i % 36 AS INT) AS c, coalesce(v, 0) AS v FROM range(10 * 36) t(i) LEFT JOIN grid ON r = i // 36 + 7 AND c = i % 36 - 2")
def to_size(spark, d):
    return _out(warps.to_size(_grid(spark, d), H, W, 10, 36))


def _down(n: int, m: int) -> str:
    s = n / m
    return f"SELECT o, i, (least((o + 1) * {s!r}::DOUBLE, i + 1) - greatest(o * {s!r}::DOUBLE, i)) / {s!r}::DOUBLE AS w FROM range({m}) a(o), range({n}) b(i) WHERE least((o + 1) * {s!r}::DOUBLE, i + 1) - greatest(o * {s!r}::DOUBLE, i) > 1e-9"


def _up(n: int, m: int) -> str:
    s = n / m
    return f"SELECT o, i, sum(w) AS w FROM (SELECT o, least({n - 1}, greatest(0, floor((o + 0.5) * {s!r}::DOUBLE - 0.5) + k)) AS i, CASE WHEN k = 0 THEN 1 - ((o + 0.5) * {s!r}::DOUBLE - 0.5 - floor((o + 0.5) * {s!r}::DOUBLE - 0.5)) ELSE (o + 0.5) * {s!r}::DOUBLE - 0.5 - floor((o + 0.5) * {s!r}::DOUBLE - 0.5) END AS w FROM range({m}) a(o), range(2) b(k)) GROUP BY 1, 2"


_RESAMPLE = "SELECT CAST(a.o AS INT) AS r, CAST(b.o AS INT) AS c, round(sum(v * a.w * b.w), 6) AS v FROM grid JOIN a ON a.i = r JOIN b ON b.i = c GROUP BY 1, 2"


@query("resample_down", f"{_G}, a AS ({_down(24, 10)}), b AS ({_down(32, 13)}) {_RESAMPLE}")
def resample_down(spark, d):
    return _out(warps.resampled(_grid(spark, d), H, W, 10, 13))


@query("resample_up", f"{_G}, a AS ({_up(24, 36)}), b AS ({_up(32, 50)}) {_RESAMPLE}")
def resample_up(spark, d):
    return _out(warps.resampled(_grid(spark, d), H, W, 36, 50))


@query("upsample_two", f"{_G}, o AS (SELECT i // 64 AS r, i % 64 AS c FROM range(48 * 64) t(i)) SELECT CAST(o.r AS INT) AS r, CAST(o.c AS INT) AS c, round((g1.v + g2.v + g3.v + g4.v) / 4, 6) AS v FROM o JOIN grid g1 ON g1.r = o.r // 2 AND g1.c = o.c // 2 JOIN grid g2 ON g2.r = least(23, (o.r + 1) // 2) AND g2.c = o.c // 2 JOIN grid g3 ON g3.r = o.r // 2 AND g3.c = least(31, (o.c + 1) // 2) JOIN grid g4 ON g4.r = least(23, (o.r + 1) // 2) AND g4.c = least(31, (o.c + 1) // 2)")
def upsample_two(spark, d):
    return _out(warps.doubled(_grid(spark, d), H, W))


def _warp_sql(y: str, x: str) -> str:
    """y and x in terms of p and q, places from the centre."""
    return f"""{_G}, o AS (SELECT r, c, {y} + 11.5::DOUBLE AS y, {x} + 15.5::DOUBLE AS x FROM (SELECT r, c, r - 11.5::DOUBLE AS p, c - 15.5::DOUBLE AS q FROM full_grid)),
s AS (SELECT r, c, floor(y) + i AS sr, floor(x) + j AS sc, abs(1 - i - (y - floor(y))) * abs(1 - j - (x - floor(x))) AS k FROM o, range(2) a(i), range(2) b(j) WHERE y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 31),
f AS (SELECT s.r, s.c, sum(k * v) AS v FROM s JOIN grid g ON g.r = sr AND g.c = sc WHERE k > 0 GROUP BY 1, 2) SELECT o.r, o.c, round(f.v, 6) AS v FROM o LEFT JOIN f USING (r, c)"""


_COS, _SIN = "cos(radians(30.0))", "sin(radians(30.0))"


@query("rotate_grid", _warp_sql(f"({_COS} * p + {_SIN} * q)", f"({_COS} * q - {_SIN} * p)"))
def rotate_grid(spark, d):
    return _out(warps.rotated(_grid(spark, d), H, W, 30.0))


@query("translate_grid", _warp_sql("(p - 2.25)", "(q + 1.5)"))
def translate_grid(spark, d):
    return _out(warps.translated(_grid(spark, d), H, W, 2.25, -1.5))


@query("homography_grid", _warp_sql("((0.9 * p + 0.1 * q + 1) / (0.002 * p - 0.003 * q + 1))", "((1.1 * q - 0.05 * p) / (0.002 * p - 0.003 * q + 1))"))
def homography_grid(spark, d):
    return _out(warps.warped(_grid(spark, d), H, W, (0.9, 0.1, 1, -0.05, 1.1, 0, 0.002, -0.003, 1)))


@query("jitter_grid", " UNION ALL ".join(f"(SELECT {n} AS n, * FROM ({_warp_sql(y, x)}))" for n, (y, x) in enumerate([("(p - 1)", "(q + 0)"), ("(p + 0.5)", "(q - 2)")])))
def jitter_grid(spark, d):
    j = warps.jittered(_grid(spark, d), H, W, [0.0], [(1.0, 0.0), (-0.5, 2.0)])
    return j.select(F.col("n").cast("int").alias("n"), "r", "c", r6("v").alias("v"))


_T = [[1.0, 2.0, 0.5], [0.0, -1.0, 3.0]]
_TSQL = "t AS (SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0::DOUBLE), (0, 2, 0.5::DOUBLE), (1, 0, 0.0::DOUBLE), (1, 1, -1.0::DOUBLE), (1, 2, 3.0::DOUBLE)) x(i, j, t))"


@query("convolve_full", f"{_G}, {_TSQL} SELECT CAST(r + i AS INT) AS r, CAST(c + j AS INT) AS c, round(sum(v * t), 6) AS v FROM grid, t GROUP BY 1, 2")
def convolve_full(spark, d):
    return _out(warps.convolved(_grid(spark, d), H, W, _T, "full"))


@query("convolve_same", f"{_G}, {_TSQL}, f AS (SELECT r + i - 1 AS r, c + j - 1 AS c, sum(v * t) AS v FROM grid, t GROUP BY 1, 2) SELECT {_RC}, round(v, 6) AS v FROM f WHERE r BETWEEN 0 AND 23 AND c BETWEEN 0 AND 31")
def convolve_same(spark, d):
    return _out(warps.convolved(_grid(spark, d), H, W, _T, "same"))


_WIN = f"{_G}, {_TSQL}, z AS (SELECT g.r - i AS r, g.c - j AS c, v, t FROM grid g, t), y AS (SELECT * FROM z WHERE r BETWEEN 0 AND 22 AND c BETWEEN 0 AND 29)"


@query("correlate_valid", f"{_WIN} SELECT {_RC}, round(sum(v * t), 6) AS v FROM y GROUP BY 1, 2")
def correlate_valid(spark, d):
    return _out(warps.correlated(_grid(spark, d), H, W, _T, "valid"))


@query("template_distance", f"{_WIN} SELECT {_RC}, round(sum((v - t) * (v - t)), 6) AS v FROM y GROUP BY 1, 2")
def template_distance(spark, d):
    return _out(warps.squared_distances(_grid(spark, d), H, W, _T))


@query("template_correlation", f"{_WIN}, s AS (SELECT r, c, sum(v * (t - m)) AS p, sum(v * v) - sum(v) * sum(v) / 6 AS b FROM y, (SELECT avg(t) AS m FROM t) GROUP BY 1, 2) SELECT {_RC}, round(CASE WHEN b > 1e-9 THEN p / sqrt(b) / (SELECT sqrt(var_pop(t) * 6) FROM t) ELSE 0 END, 6) AS v FROM s")
def template_correlation(spark, d):
    return _out(warps.normalised_correlation(_grid(spark, d), H, W, _T))


@query("template_masked", f"{_WIN.replace('v, t FROM grid g, t)', 'v, t FROM grid g, t WHERE i + j <> 1)')}, s AS (SELECT r, c, sum(v * (t - m)) AS p, sum(v * v) - sum(v) * sum(v) / 4 AS b FROM y, (SELECT avg(t) AS m FROM t WHERE i + j <> 1) GROUP BY 1, 2) SELECT {_RC}, round(CASE WHEN b > 1e-9 THEN p / sqrt(b) / (SELECT sqrt(var_pop(t) * 4) FROM t WHERE i + j <> 1) ELSE 0 END, 6) AS v FROM s")
def template_masked(spark, d):
    return _out(warps.normalised_correlation(_grid(spark, d), H, W, _T, [[1, 0, 1], [0, 1, 1]]))


@query("filter_bank", f"{_G}, {_TSQL}, f AS (SELECT 0 AS f, r + i - 1 AS r, c + j - 1 AS c, sum(v * t) AS v FROM grid, t GROUP BY 2, 3 UNION ALL SELECT 1, r, c + j - 1, sum(v * (j - 1)) FROM grid, range(3) k(j) GROUP BY 2, 3) SELECT f, {_RC}, round(v, 6) AS v FROM f WHERE r BETWEEN 0 AND 23 AND c BETWEEN 0 AND 31")
def filter_bank(spark, d):
    return warps.filter_bank(_grid(spark, d), H, W, [_T, [[-1.0, 0.0, 1.0]]]).select("f", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), r6("v").alias("v"))


@query("block_sum", f"{_G} SELECT CAST(r // 5 AS INT) AS r, CAST(c // 7 AS INT) AS c, sum(v) AS v FROM grid WHERE r < 20 AND c < 28 GROUP BY 1, 2")
def block_sum(spark, d):
    return _out(warps.blocks(_grid(spark, d), H, W, 5, 7, "sum"))


@query("shrink", f"{_G} SELECT CAST(r // 5 AS INT) AS r, CAST(c // 7 AS INT) AS c, round(avg(v), 6) AS v FROM grid WHERE r < 20 AND c < 28 GROUP BY 1, 2")
def shrink(spark, d):
    return _out(warps.blocks(_grid(spark, d), H, W, 5, 7, "avg"))


@query("block_min", f"{_G} SELECT CAST(r // 4 AS INT) AS r, CAST(c // 4 AS INT) AS c, min(v) AS v FROM grid GROUP BY 1, 2")
def block_min(spark, d):
    return _out(warps.blocks(_grid(spark, d), H, W, 4, 4, "min"))


@query("window_histograms", f"{_G}, b AS (SELECT r, c, CASE WHEN v < 1 THEN 0 WHEN v < 3 THEN 1 WHEN v <= 50 THEN 2 END AS bin FROM grid) SELECT a.r, a.c, bin, count(*) AS n FROM full_grid a JOIN b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 WHERE bin IS NOT NULL GROUP BY 1, 2, 3")
def window_histograms(spark, d):
    return warps.window_histograms(_grid(spark, d), H, W, [0.0, 1.0, 3.0, 50.0], 2).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "bin", "n")


@query("grid_moments", f"{_G}, m AS (SELECT sum(v) AS s, sum(r * v) / sum(v) AS mr, sum(c * v) / sum(v) AS mc FROM grid) SELECT round(any_value(s), 6) AS weight, round(any_value(mr), 6) AS mr, round(any_value(mc), 6) AS mc, round(sum(v * (r - mr) * (r - mr)) / any_value(s), 6) AS vr, round(sum(v * (c - mc) * (c - mc)) / any_value(s), 6) AS vc, round(sum(v * (r - mr) * (c - mc)) / any_value(s), 6) AS vrc FROM grid, m")
def grid_moments(spark, d):
    m = warps.moments(_grid(spark, d))
    return m.select(*(r6(c).alias(c) for c in m.columns))


_PTS = "p AS (SELECT event_id AS n, CAST(user_id % 20 AS INT) AS r, CAST(event_id % 25 AS INT) AS c, value AS v FROM events)"


def _points(spark, d):
    return I.table(spark, d, "events").select(F.col("event_id").alias("n"), (F.col("user_id") % 20).cast("int").alias("r"), (F.col("event_id") % 25).cast("int").alias("c"), F.col("value").alias("v"))


@query("points_to_grid", f"WITH {_PTS}, l AS (SELECT r, c, arg_max(v, n) AS v FROM p GROUP BY 1, 2) SELECT CAST(i // 25 AS INT) AS r, CAST(i % 25 AS INT) AS c, coalesce(v, -1) AS v FROM range(500) t(i) LEFT JOIN l ON r = i // 25 AND c = i % 25")
def points_to_grid(spark, d):
    return warps.dense(_points(spark, d), 20, 25, -1.0)


@query("blend", f"{_G}, w AS (SELECT r, c, v, (r % 3)::DOUBLE AS m, 31 - v AS v2, (c % 2)::DOUBLE AS m2 FROM grid) SELECT r, c, round((m * v + m2 * v2) / nullif(m + m2, 0), 6) AS v FROM w")
def blend(spark, d):
    g = _grid(spark, d)
    two = g.select("r", "c", (31 - F.col("v")).alias("v"), (F.col("c") % 2).cast("double").alias("m"))
    return _out(warps.blended(g.withColumn("m", (F.col("r") % 3).cast("double")), two))


def _tap(i: str, n: int, m: int) -> str:
    """(o, i, k): weights of n cells for each of m by linear interpolation upwards."""
    u = f"((o + 0.5::DOUBLE) * {n} / {m} - 0.5)"
    return f"SELECT o, greatest(0, least({n - 1}, CAST(floor({u}) AS INT) + e)) AS {i}, CASE e WHEN 0 THEN 1 - ({u} - floor({u})) ELSE {u} - floor({u}) END AS k FROM range({m}) t(o), range(2) s(e)"


_FIELD = f"""{_G}, a AS ({_tap("r", 26, 36)}), b AS ({_tap("c", 34, 48)}), z AS (SELECT a.o AS y, b.o AS x, sum(a.k * b.k * v) * sqrt(2) AS ty, sum(a.k * b.k * (31 - v)) * sqrt(2) AS tx, sum(a.k * b.k * (v / 10 - 1)) * sqrt(2) AS s
FROM a, b JOIN grid g ON g.r = least(a.r, 23) AND g.c = least(b.c, 31) WHERE a.o < 34 AND b.o < 46 GROUP BY ALL)
SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(least(29, greatest(0, ty * 1.6)), 6) AS ty, round(least(37, greatest(0, tx * 1.25)), 6) AS tx"""


def _old_field(spark, d):
    k = F.sqrt(F.lit(2.0))  # no short decimals, which end in ties of the last digit shown
    return _grid(spark, d).select(F.col("r").alias("y"), F.col("c").alias("x"), (k * F.col("v")).alias("ty"), (k * (31 - F.col("v"))).alias("tx"), F.lit(0.0).alias("angle"), (k * (F.col("v") / 10 - 1)).alias("sy"), (k * (1 - F.col("v") / 10)).alias("sx"))


@query("scale_field", f"{_FIELD} FROM z")
def scale_field(spark, d):
    return warps.scaled_field(_old_field(spark, d), (20, 32), (32, 40), (24, 32), (36, 48), 3).select("y", "x", r6("ty").alias("ty"), r6("tx").alias("tx"))


@query("scale_field_sizes", f"{_FIELD}, round(sign(s) * greatest(0.5, least(2, abs(s))), 6) + 0.0 AS sy, round(-sign(s) * greatest(0.5, least(2, abs(s))), 6) + 0.0 AS sx FROM z WHERE abs(s) > 1e-9")
def scale_field_sizes(spark, d):
    f = warps.scaled_field(_old_field(spark, d), (20, 32), (32, 40), (24, 32), (36, 48), 3, (0.5, 2.0))
    # a size of 0 has no sign, so rounding decides
    return f.where("abs(sy) > 0").select("y", "x", r6("ty").alias("ty"), r6("tx").alias("tx"), (r6("sy") + 0.0).alias("sy"), (r6("sx") + 0.0).alias("sx"))


@query("difference_matrix", f"{_G} SELECT axis, c * 24 + r AS row, c * 24 + r + step AS col, value FROM full_grid, (VALUES ('x', 0, 1.0::DOUBLE), ('x', 24, -1.0::DOUBLE), ('y', 0, 1.0::DOUBLE), ('y', 1, -1.0::DOUBLE)) t(axis, step, value) WHERE (axis = 'x' AND c < 31) OR (axis = 'y' AND r < 23)")
def difference_matrix(spark, d):
    return warps.differences(_grid(spark, d), H, W)


@query("difference_matrix_masked", f"{_G} SELECT axis, c * 24 + r AS row, c * 24 + r + step AS col, value * (r % 3) AS value FROM full_grid, (VALUES ('x', 0, 1.0::DOUBLE), ('x', 24, -1.0::DOUBLE), ('y', 0, 1.0::DOUBLE), ('y', 1, -1.0::DOUBLE)) t(axis, step, value) WHERE ((axis = 'x' AND c < 31) OR (axis = 'y' AND r < 23)) AND r % 3 > 0")
def difference_matrix_masked(spark, d):
    g = _grid(spark, d)
    return warps.differences(g, H, W, g.withColumn("m", (F.col("r") % 3).cast("double")))


_TWO = f"{_G}, w AS (SELECT r, c, [v, v + 1, v * 2, r - 10, c - 5.5] AS a, (1 + r % 3)::DOUBLE AS m, [-v, v - 1, v * 3, c - 12, r - 3.25] AS b, (c % 2)::DOUBLE AS n FROM grid), x AS (SELECT *, CASE WHEN m * (a[4] * a[4] + a[5] * a[5]) > n * (b[4] * b[4] + b[5] * b[5]) THEN a ELSE b END AS p FROM w)"
_MEAN = lambda i: f"round((m * a[{i}] + n * b[{i}]) / (m + n), 6)"


def _combined(spark, d, strongest):
    g = _grid(spark, d)
    r, c, v = (F.col(n).cast("double") for n in "rcv")
    one = g.select("r", "c", F.array(v, v + 1, v * 2, r - 10, c - 5.5).alias("v"), (1 + F.col("r") % 3).cast("double").alias("m"))
    two = g.select("r", "c", F.array(-v, v - 1, v * 3, c - 12, r - 3.25).alias("v"), (F.col("c") % 2).cast("double").alias("m"))
    return warps.combined(one, two, strongest).select("r", "c", *((r6(F.get("v", F.lit(i))) + 0.0).alias(f"v{i}") for i in range(5)))


@query("combine_means", f"{_TWO} SELECT r, c, round(p[1], 6) + 0.0 AS v0, {_MEAN(2)} + 0.0 AS v1, {_MEAN(3)} + 0.0 AS v2, {_MEAN(4)} + 0.0 AS v3, {_MEAN(5)} + 0.0 AS v4 FROM x")
def combine_means(spark, d):
    return _combined(spark, d, False)


@query("combine_strongest", f"{_TWO} SELECT r, c, round(p[1], 6) + 0.0 AS v0, {_MEAN(2)} + 0.0 AS v1, {_MEAN(3)} + 0.0 AS v2, round(p[4], 6) + 0.0 AS v3, round(p[5], 6) + 0.0 AS v4 FROM x")
def combine_strongest(spark, d):
    return _combined(spark, d, True)


@query("to_size_odd", f"{_G} SELECT CAST(i // 35 AS INT) AS r, CAST(i % 35 AS INT) AS c, coalesce(v, 0) AS v FROM range(11 * 35) t(i) LEFT JOIN grid ON r = i // 35 + 7 AND c = i % 35 - 1")
def to_size_odd(spark, d):
    return _out(warps.to_size(_grid(spark, d), H, W, 11, 35))


_FR = "f AS (SELECT event_id AS id, (event_id % 50)::DOUBLE AS x, (user_id % 40)::DOUBLE AS y, (1 + event_id % 9)::DOUBLE AS a, value / 100 AS b FROM events)"


def _frames(spark, d):
    return I.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 50).cast("double").alias("x"), (F.col("user_id") % 40).cast("double").alias("y"), (1 + F.col("event_id") % 9).cast("double").alias("a"), (F.col("value") / 100).alias("b"))


def _named(df, cols, names, *keep):
    return df.select(*keep, *(r6(c + 0.0).alias(n) for c, n in zip(cols, names, strict=True)))


@query("frame_discs", f"WITH {_FR} SELECT id, x AS e0, y AS e1, round(a * cos(b), 6) + 0.0 AS e2, round(a * sin(b), 6) + 0.0 AS e3, round(-a * sin(b), 6) + 0.0 AS e4, round(a * cos(b), 6) + 0.0 AS e5 FROM f")
def frame_discs(spark, d):
    return _named(_frames(spark, d), frames.oriented_ellipse([F.col(c) for c in "xyab"]), [f"e{i}" for i in range(6)], "id")


@query("frame_ellipses", f"WITH {_FR} SELECT id, x AS e0, y AS e1, round(sqrt(a), 6) AS e2, round(b / sqrt(a), 6) + 0.0 AS e3, 0.0::DOUBLE AS e4, round(sqrt(a + b * b - b * b / a), 6) AS e5 FROM f")
def frame_ellipses(spark, d):
    f = [F.col("x"), F.col("y"), F.col("a"), F.col("b"), F.col("a") + F.col("b") * F.col("b")]
    return _named(_frames(spark, d), frames.oriented_ellipse(f), [f"e{i}" for i in range(6)], "id")


@query("region_transpose", f"WITH {_FR} SELECT id, y AS e0, x AS e1, round(x + y, 6) AS e2, round(b, 6) + 0.0 AS e3, a AS e4 FROM f")
def region_transpose(spark, d):
    f = [F.col("x"), F.col("y"), F.col("a"), F.col("b"), F.col("x") + F.col("y")]
    return _named(_frames(spark, d), frames.transposed_region(f), [f"e{i}" for i in range(5)], "id")


@query("skew_matrix", f"WITH {_FR} SELECT id, 0.0::DOUBLE AS m0, round(-b, 6) + 0.0 AS m1, y AS m2, round(b, 6) + 0.0 AS m3, 0.0::DOUBLE AS m4, -x + 0.0 AS m5, -y + 0.0 AS m6, x AS m7, 0.0::DOUBLE AS m8, x AS w0, y AS w1, round(b, 6) + 0.0 AS w2 FROM f")
def skew_matrix(spark, d):
    m = frames.skew(F.col("x"), F.col("y"), F.col("b"))
    return _named(_frames(spark, d), [*m, *frames.unskew(m)], [*(f"m{i}" for i in range(9)), "w0", "w1", "w2"], "id")


@query("affine_derivatives", f"WITH {_FR} SELECT id, x AS d0, 0.0::DOUBLE AS d1, y AS d2, 0.0::DOUBLE AS d3, 1.0::DOUBLE AS d4, 0.0::DOUBLE AS d5, 0.0::DOUBLE AS f0, x AS f1, 0.0::DOUBLE AS f2, y AS f3, 0.0::DOUBLE AS f4, 1.0::DOUBLE AS f5 FROM f")
def affine_derivatives(spark, d):
    a, b = frames.affine_derivatives(F.col("x"), F.col("y"))
    return _named(_frames(spark, d), [*a, *b], [f"{n}{i}" for n in "df" for i in range(6)], "id")


_REF = "WITH " + I.BOXES + ", z AS (SELECT *, (id % 7)::DOUBLE AS rx, (id % 5)::DOUBLE AS ry, (id % 4)::DOUBLE AS rw, (1 + id % 6)::DOUBLE AS rh FROM box)"


def _boxes(spark, d):
    k = F.col("id")
    return I.boxes(spark, d).select("*", *((o + k % m).cast("double").alias(n) for n, o, m in (("rx", 0, 7), ("ry", 0, 5), ("rw", 0, 4), ("rh", 1, 6))))


@query("box_relative", f"{_REF} SELECT id, round((x - rx) / (CASE WHEN rw = 0 THEN 1 ELSE rw END), 6) AS x, round((y - ry) / rh, 6) AS y, round(w / (CASE WHEN rw = 0 THEN 1 ELSE rw END), 6) AS w, round(h / rh, 6) AS h FROM z")
def box_relative(spark, d):
    return _named(_boxes(spark, d), frames.relative([F.col(c) for c in "xywh"], [F.col(f"r{c}") for c in "xywh"]), "xywh", "id")


@query("box_absolute", f"{_REF} SELECT id, round(x * (CASE WHEN rw = 0 THEN 1 ELSE rw END) + rx, 6) AS x, round(y * rh + ry, 6) AS y, round(w * (CASE WHEN rw = 0 THEN 1 ELSE rw END), 6) AS w, round(h * rh, 6) AS h FROM z")
def box_absolute(spark, d):
    return _named(_boxes(spark, d), frames.absolute([F.col(c) for c in "xywh"], [F.col(f"r{c}") for c in "xywh"]), "xywh", "id")


_TURN = "a AS (SELECT *, radians((id % 12) * 30.0) AS t FROM box)"


@query("box_extent", f"WITH {I.BOXES}, {_TURN}, b AS (SELECT *, w * abs(cos(t)) + h * abs(sin(t)) AS ew, w * abs(sin(t)) + h * abs(cos(t)) AS eh, sqrt((w * cos(t)) ** 2 + (h * sin(t)) ** 2) AS ow, sqrt((w * sin(t)) ** 2 + (h * cos(t)) ** 2) AS oh FROM a) SELECT id, round(x + w / 2 - ew / 2, 6) AS x, round(y + h / 2 - eh / 2, 6) AS y, round(ew, 6) AS w, round(eh, 6) AS h, round(x + w / 2 - ow / 2, 6) AS ox, round(y + h / 2 - oh / 2, 6) AS oy, round(ow, 6) AS ow, round(oh, 6) AS oh FROM b")
def box_extent(spark, d):
    box, turn = [F.col(c) for c in "xywh"], (F.col("id") % 12) * 30.0
    return _named(I.boxes(spark, d), [*frames.extent(box, turn), *frames.extent(box, turn, True)], ["x", "y", "w", "h", "ox", "oy", "ow", "oh"], "id")


_LIST = "q AS (SELECT event_id AS id, (event_id * 37 % 400)::DOUBLE AS y, (event_id * 91 % 600)::DOUBLE AS x, value AS v FROM events)"


def _list(spark, d):
    e = F.col("event_id")
    return I.table(spark, d, "events").select(e.alias("id"), (e * 37 % 400).cast("double").alias("y"), (e * 91 % 600).cast("double").alias("x"), F.col("value").alias("v"))


@query("strongest_points", f"WITH {_LIST}, s AS (SELECT * FROM q WHERE v > 5) SELECT id, y, x, v FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE abs(o.y - s.y) <= 4 AND abs(o.x - s.x) <= 6 AND o.v > s.v)")
def strongest_points(spark, d):
    return frames.strongest(_list(spark, d), (4.0, 6.0), 5.0)


@query("strongest_few", f"WITH {_LIST} SELECT id, y, x, v FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE abs(o.y - q.y) <= 4 AND abs(o.x - q.x) <= 6 AND o.v >= q.v AND o.id <> q.id) ORDER BY v DESC, id LIMIT 20")
def strongest_few(spark, d):
    return frames.strongest(_list(spark, d), (4.0, 6.0), most=20, ties=True)


@query("points_in_window", f"WITH {_LIST} SELECT * FROM q WHERE y BETWEEN 50 AND 150 AND x BETWEEN 20 AND 300")
def points_in_window(spark, d):
    return frames.windowed(_list(spark, d), (50.0, 20.0), (150.0, 300.0))


@query("most_frequent", "WITH n AS (SELECT l_returnflag AS g, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT g, arg_min(x, (-n, x)) AS mode FROM n GROUP BY 1")
def most_frequent(spark, d):
    return frames.mode_of(I.weighted(spark, d), "g", "x").select("g", "mode")


_HITS = "h AS (SELECT event_id AS id, value AS score, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_id % 9 = 0 THEN -1 ELSE 0 END AS hit FROM events), u AS (SELECT id, score, sum((hit = 1)::INT) OVER w AS tp, sum((hit = 0)::INT) OVER w AS fp FROM h WHERE hit <> -1 WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"


def _hits(spark, d):
    hit = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_id") % 9 == 0, -1).otherwise(0)
    return I.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), hit.alias("hit"))


@query("detection_roc", f"WITH {_HITS} SELECT id, score, round(fp / 40.0::DOUBLE, 6) AS x, round(tp / 500.0::DOUBLE, 6) AS y FROM u")
def detection_roc(spark, d):
    return frames.matched_curve(_hits(spark, d), 500, 40).select("id", "score", r6("x").alias("x"), r6("y").alias("y"))


@query("detection_pr", f"WITH {_HITS} SELECT id, score, round(tp / 500.0::DOUBLE, 6) AS x, round(tp / (fp + tp)::DOUBLE, 6) AS y FROM u")
def detection_pr(spark, d):
    return frames.matched_curve(_hits(spark, d), 500, 40, roc=False).select("id", "score", r6("x").alias("x"), r6("y").alias("y"))

"""Queries: random forests, stumps, principal components, k-d forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import forest, kdforest, pca
from . import inputs as I
from .q_core import _NEAR
from .registry import query

r6 = lambda c: F.round(c, 6)
BINS, TREES, CLASSES = 16, 10, 10


def _classes(spark, d):
    return I.vectors(spark, d).select("id", "x", (F.col("label") + 1).alias("cls"))


def _grown(spark, d, criterion="gini", depth=1):
    rows = _classes(spark, d)
    return rows, forest.train(rows, forest.uniform_edges(rows, BINS), forest.Options(classes=CLASSES, trees=TREES, criterion=criterion, depth=depth, least_count=5, least_child=2))


_U = lambda *parts: f"((('0x' || substr(md5(concat_ws(',', {', '.join(parts)})), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"
_GINI = "(wl - gl / wl + wr - gr / wr) / w", "1 - g / (w * w)"


def _levels(depth: int, score: str, start: str) -> str:
    """CTEs t0 .. (rows at nodes), s0 .. (nodes) and c0 .. (splits) of the forest's levels."""
    out = f"""{I.VEC}, e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM vec GROUP BY c),
b AS (SELECT id, c, len(list_filter(range(1, {BINS}), lambda j: lo + (hi - lo) * j / {BINS} <= v)) AS b, label + 1 AS cls FROM vec JOIN e USING (c)),
ids AS (SELECT DISTINCT id, cls FROM b), t0 AS (SELECT tree, id, cls, 1::BIGINT AS node FROM (SELECT tree, id, cls, row_number() OVER (PARTITION BY tree ORDER BY -ln({_U("0", "tree", "id")}), id) AS r FROM ids, range({TREES}) x(tree)) WHERE r <= (SELECT 5 * count(*) // {TREES} FROM ids))"""
    for k in range(depth + 1):
        first = "2" if k == 0 else "2 + " + " + ".join(f"2 * (SELECT count(*) FROM c{j} z WHERE z.tree = p{k}.tree)" for j in range(k))
        out += f""", n{k} AS (SELECT tree, node, cls, count(*) AS n FROM t{k} GROUP BY ALL), s{k} AS (SELECT tree, node, sum(n) AS cnt, count(*) AS kinds FROM n{k} GROUP BY ALL),
f{k} AS (SELECT tree, node, f FROM (SELECT tree, node, f, row_number() OVER (PARTITION BY tree, node ORDER BY -ln({_U("0", "-1", "tree", "node", "f")}), f) AS r FROM s{k}, range(64) y(f) WHERE cnt > 5 AND kinds > 1) WHERE r <= 8),
h{k} AS (SELECT t.tree, t.node, f, b.b, t.cls, count(*) AS n FROM t{k} t JOIN f{k} USING (tree, node) JOIN b ON b.id = t.id AND b.c = f GROUP BY ALL),
l{k} AS (SELECT tree, node, f, j, cls, sum(CASE WHEN b <= j THEN n ELSE 0 END)::DOUBLE AS l, sum(n)::DOUBLE AS t FROM h{k}, range({BINS - 1}) z(j) GROUP BY ALL),
g{k} AS (SELECT tree, node, f, j, sum(l) AS wl, sum(t - l) AS wr, sum(l * l) AS gl, sum((t - l) * (t - l)) AS gr, sum(t) AS w, sum(t * t) AS g, list(l) AS ll, list(t) AS lt FROM l{k} GROUP BY ALL),
v{k} AS (SELECT tree, node, f, j, wl, wr, round({score}, 10) AS v, {start} AS start FROM g{k} WHERE wl > 0 AND wr > 0),
p{k} AS (SELECT tree, node, f, j FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY v, f, j) AS r FROM v{k}) WHERE r = 1 AND start - v > 1e-10 AND wl >= 2 AND wr >= 2),
c{k} AS (SELECT tree, node, f, j, {first} + 2 * (row_number() OVER (PARTITION BY tree ORDER BY node) - 1) AS child FROM p{k}),
t{k + 1} AS (SELECT tree, t.id, t.cls, child + (b.b > j)::INT AS node FROM t{k} t JOIN c{k} USING (tree, node) JOIN b ON b.id = t.id AND b.c = f)"""
    k = depth + 1
    return out + f", n{k} AS (SELECT tree, node, cls, count(*) AS n FROM t{k} GROUP BY ALL), s{k} AS (SELECT tree, node, sum(n) AS cnt, count(*) AS kinds FROM n{k} GROUP BY ALL)"


_ENTROPY = (
    "-(list_sum(list_transform(ll, lambda x: CASE WHEN x > 0 THEN x * log2(x / wl) ELSE 0 END)) + list_sum(list_transform(list_zip(ll, lt), lambda x: CASE WHEN x[2] - x[1] > 0 THEN (x[2] - x[1]) * log2((x[2] - x[1]) / wr) ELSE 0 END))) / w",
    "-list_sum(list_transform(lt, lambda x: x * log2(x / w))) / w",
)


def _nodes(depth: int) -> str:
    level = lambda k: f"""SELECT n.tree, n.node, {'c.f' if k <= depth else 'NULL::BIGINT'} AS fid, {f'round(lo + (hi - lo) * (c.j + 1) / {BINS}, 9)' if k <= depth else 'NULL::DOUBLE'} AS thr, {'coalesce(c.child, 0)' if k <= depth else '0'} AS child, any_value(s.cnt) AS count, {k} AS depth, n.cls, round(any_value(n.n) / any_value(s.cnt)::DOUBLE, 9) AS share
FROM n{k} n JOIN s{k} s USING (tree, node){f' LEFT JOIN c{k} c USING (tree, node) LEFT JOIN e ON e.c = c.f' if k <= depth else ''} GROUP BY ALL"""  # noqa: E731
    return " UNION ALL ".join(level(k) for k in range(depth + 2))


_SHOWN = "CAST(tree AS INT) AS tree, CAST(node AS BIGINT) AS node, CAST(fid AS INT) AS fid, thr, CAST(child AS BIGINT) AS child, CAST(count AS BIGINT) AS count, CAST(depth AS INT) AS depth, CAST(cls AS INT) AS cls, share"


def _shown(model):
    long = model.select("tree", "node", "fid", F.round("thr", 9).alias("thr"), "child", "count", "depth", F.posexplode("distr").alias("k", "share"))
    return long.where("share > 0").select("tree", "node", "fid", "thr", "child", "count", "depth", (F.col("k") + 1).alias("cls"), F.round("share", 9).alias("share"))


@query("forest_gini", f"WITH {_levels(1, *_GINI)} SELECT {_SHOWN} FROM ({_nodes(1)})")
def forest_gini(spark, d):
    return _shown(_grown(spark, d)[1])


@query("forest_entropy", f"WITH {_levels(1, *_ENTROPY)} SELECT {_SHOWN} FROM ({_nodes(1)})")
def forest_entropy(spark, d):
    return _shown(_grown(spark, d, "entropy")[1])


_DOWN = """a0 AS (SELECT id, tree, 1::BIGINT AS node FROM ids, range(10) x(tree)),
a1 AS (SELECT a.id, tree, coalesce(child + (b.b > j)::INT, node) AS node FROM a0 a LEFT JOIN c0 USING (tree, node) LEFT JOIN b ON b.id = a.id AND b.c = f),
a2 AS (SELECT a.id, tree, coalesce(child + (b.b > j)::INT, node) AS node FROM a1 a LEFT JOIN c1 USING (tree, node) LEFT JOIN b ON b.id = a.id AND b.c = f),
sh AS (SELECT tree, node, cls, n / sum(n) OVER (PARTITION BY tree, node)::DOUBLE AS p FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2)),
ps AS (SELECT id, cls, round(sum(p) / 10, 12) AS p FROM a2 JOIN sh USING (tree, node) GROUP BY ALL)"""


@query("forest_apply", f"WITH {_levels(1, *_GINI)}, {_DOWN} SELECT id, CAST(arg_min(cls, (-p, cls)) AS INT) AS hs, round(max(p), 9) AS p FROM ps GROUP BY id")
def forest_apply(spark, d):
    rows, model = _grown(spark, d)
    return forest.apply(rows, model).select("id", "hs", F.round(F.array_max("ps"), 9).alias("p"))


# no SQL: trees of ten levels; tests hold them against a plain trainer
@query("forest_confusion")
def forest_confusion(spark, d):
    rows, model = _grown(spark, d, depth=10)
    return rows.select("id", "cls").join(forest.apply(rows, model), "id").groupBy("cls", "hs").agg(F.count(F.lit(1)).alias("n"))


@query("stump_errors", f"""WITH {I.VEC}, e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM vec GROUP BY c), n AS (SELECT count(*) AS n FROM embeddings), q AS (SELECT count(*) AS n1 FROM embeddings WHERE label < 5),
b AS (SELECT id, c, len(list_filter(range(1, 256), lambda j: lo + (hi - lo) * j / 256 <= v)) AS b, label < 5 AS one FROM vec JOIN e USING (c)),
h AS (SELECT c, b, sum(CASE WHEN one THEN -1 ELSE 1 END) AS d FROM b GROUP BY ALL),
r AS (SELECT c, j, round(((SELECT n1 FROM q) + coalesce(sum(CASE WHEN b <= j THEN d END), 0)) / (SELECT n FROM n)::DOUBLE, 9) AS e FROM h, range(256) t(j) GROUP BY ALL)
SELECT CAST(c AS INT) AS f, round(min(least(e, 1 - e)), 9) AS err FROM r GROUP BY c""")
def stump_errors(spark, d):
    rows = I.vectors(spark, d)
    n = rows.count()
    weighted = rows.select("id", "x", (F.col("label") < 5).cast("int").alias("cls"), F.lit(1.0 / max(n, 1)).alias("w"))
    made = forest.stumps(forest.binned(weighted, forest.uniform_edges(rows, 256)), 256)
    return made.select("f", F.round("err", 9).alias("err"))


# no SQL: ferns are drawn by numpy's generator; tests hold them against a plain trainer
@query("fern_regression")
def fern_regression(spark, d):
    rows = I.vectors(spark, d).select("id", "x", F.col("label").cast("double").alias("y"))
    ferns = forest.train_ferns(rows, 20, 64, depth=3, tries=8, low=-0.3, high=0.3, eta=0.5)
    return forest.apply_ferns(rows, ferns, 64).select("id", r6("y").alias("y"))


@query("pca_covariance", f"WITH {I.VEC} SELECT CAST(a.c AS INT) AS i, CAST(b.c AS INT) AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS v FROM vec a JOIN vec b ON a.id = b.id AND a.c <= b.c GROUP BY 1, 2")
def pca_covariance(spark, d):
    return pca.covariance(I.vectors(spark, d)).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


_POWER = """cov AS (SELECT a.c AS i, b.c AS j, covar_samp(a.v, b.v) AS v FROM vec a JOIN vec b ON a.id = b.id GROUP BY 1, 2),
s0 AS (SELECT max(v) AS m FROM cov), p0 AS (SELECT i, j, v / m AS v FROM cov, s0)"""


def _squarings(times: int) -> str:
    """The matrix's powers by squaring: its column of largest norm becomes the first component."""
    out = ""
    for k in range(times):
        out += f", q{k + 1} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{k} a JOIN p{k} b ON a.j = b.i GROUP BY 1, 2), p{k + 1} AS (SELECT i, j, v / max(abs(v)) OVER () AS v FROM q{k + 1})"
    return out


@query("pca_first", f"""WITH {I.VEC}, {_POWER}{_squarings(14)}, t AS (SELECT j FROM p14 GROUP BY j ORDER BY sum(v * v) DESC, j LIMIT 1), c AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS u FROM p14 WHERE j = (SELECT j FROM t)),
g AS (SELECT arg_max(sign(u), (abs(round(u, 12)), -i)) AS s FROM c) SELECT CAST(i AS INT) AS i, round(u * s, 5) + 0.0 AS u FROM c, g""")
def pca_first(spark, d):
    basis = pca.fit(I.vectors(spark, d))
    return spark.createDataFrame([(i, round(float(u), 5) + 0.0) for i, u in enumerate(basis.components[0])], "i int, u double")


@query("pca_total_variance", f"WITH {I.VEC} SELECT round(sum(v), 6) AS variance FROM (SELECT var_samp(v) AS v FROM vec GROUP BY c)")
def pca_total_variance(spark, d):
    basis = pca.fit(I.vectors(spark, d))
    return spark.createDataFrame([(round(float(basis.variances.sum()), 6),)], "variance double")


# no SQL: all components; tests hold them against numpy
@query("pca_shares")
def pca_shares(spark, d):
    basis = pca.fit(I.vectors(spark, d))
    rows = [(k, round(float(v), 6), round(float(s), 6)) for k, (v, s) in enumerate(zip(basis.variances, basis.shares(), strict=True), 1)]
    return spark.createDataFrame(rows, "k int, variance double, explained double")


def _queries(v):
    return v.where(F.col("id") % 50 == 0)


@query("kd_neighbours", f"{_NEAR} SELECT query, id, place, round(dist, 6) AS distance FROM o WHERE place <= 7")
def kd_neighbours(spark, d):
    v = I.vectors(spark, d)
    index = kdforest.build(v, cells=32)
    return kdforest.search(index, _queries(v), 7, skip_self=True).select("query", "id", F.col("place").cast("long").alias("place"), r6("distance").alias("distance"))


# no SQL: a forest with a limit; recall is measured against the exact search of the same queries
@query("kd_recall")
def kd_recall(spark, d):
    v = I.vectors(spark, d)
    near = kdforest.search(kdforest.build(v, trees=4, cells=32), _queries(v), 7, limit=int(np.ceil(0.5 * v.count())), skip_self=True)
    exact = kdforest.search(kdforest.build(v, cells=32), _queries(v), 7, skip_self=True)
    hit = exact.select("query", "id").join(near.select("query", "id", "compared"), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("compared") / F.count(F.lit(1))).alias("recall"), F.max("compared").alias("compared"))

"""Queries: clustering, encodings, trees, patch fields, texts, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, text
from ..operators import cluster, encode, intervals, patchfield, trees
from ..operators.neighbors import nearest_centre
from . import inputs as I
from .registry import query

r6 = lambda c: F.round(c, 6)
_ASG = f"{I.VEC}, {I.CENTRES}, dst AS (SELECT id, k, sum((v - m) * (v - m)) AS dist FROM vec JOIN cen USING (c) GROUP BY id, k), asg AS (SELECT id, arg_min(k, (dist, k)) AS k FROM dst GROUP BY id)"


@query("kmeans_step", f"WITH {_ASG} SELECT asg.k, c AS i, round(avg(v), 6) AS m FROM asg JOIN vec USING (id) GROUP BY 1, 2")
def kmeans_step(spark, d):
    return cluster.kmeans_step(I.vectors(spark, d), I.centres(spark, d)).select("k", F.posexplode("c").alias("i", "m")).select("k", "i", r6("m").alias("m"))


@query("kmeans_energy")
def kmeans_energy(spark, d):
    _, energies = cluster.kmeans(I.vectors(spark, d), I.centres(spark, d), rounds=4)
    return spark.createDataFrame(list(enumerate(energies)), "round int, energy double")


@query("clusters_by_size", f"WITH {_ASG}, n AS (SELECT k, CAST(row_number() OVER (ORDER BY count(*) DESC, k) AS INT) AS lbl FROM asg GROUP BY k) SELECT id, lbl FROM asg JOIN n USING (k)")
def clusters_by_size(spark, d):
    return cluster.sized(nearest_centre(I.vectors(spark, d), I.centres(spark, d)))


def _modes(spark, d):
    """One mode for each label: rounded means and variances, equal priors."""
    v = I.vectors(spark, d).select(F.col("label").alias("k"), F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.round(F.avg("v"), 6).alias("m"), F.greatest(F.round(F.var_pop("v"), 6), F.lit(1e-4)).alias("s"))
    a = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    return v.groupBy("k").agg(a.alias("a")).select("k", F.transform("a", lambda t: t["m"]).alias("mean"), F.transform("a", lambda t: t["s"]).alias("variance"), F.lit(0.1).alias("prior"))


_GMM = f"""{I.VEC}, mod AS (SELECT label AS k, c, round(avg(v), 6) AS m, greatest(round(var_pop(v), 6), 1e-4) AS s FROM vec GROUP BY 1, 2),
lg AS (SELECT id, mod.k, ln(0.1::DOUBLE) + sum(-0.5 * ((v - m) * (v - m) / s + ln(s) + ln(2 * pi()))) AS l FROM vec JOIN mod USING (c) GROUP BY 1, 2),
ex AS (SELECT id, k, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM lg), pos AS (SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS p FROM ex)"""


@query("gmm_posterior", f"WITH {_GMM} SELECT id, k, round(p, 6) AS p FROM pos")
def gmm_posterior(spark, d):
    return cluster.posteriors(I.vectors(spark, d), _modes(spark, d)).select("id", "k", r6("p").alias("p"))


@query("gmm_step", f"""WITH {_GMM}, s AS (SELECT pos.k, c, sum(p) AS w, sum(p * v) AS a, sum(p * v * v) AS b FROM pos JOIN vec USING (id) WHERE p >= 1e-3 GROUP BY 1, 2)
SELECT k, c AS i, round(a / w, 5) AS mean, round(greatest(1e-4, b / w - (a / w) * (a / w)), 5) AS variance, round(w / (SELECT count(*) FROM embeddings), 5) AS prior FROM s""")
def gmm_step(spark, d):
    m = cluster.em_step(I.vectors(spark, d), _modes(spark, d))
    z = m.select("k", "prior", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "z"))
    return z.select("k", "i", F.round("z.mean", 5).alias("mean"), F.round("z.variance", 5).alias("variance"), F.round("prior", 5).alias("prior"))


@query("fisher", f"""WITH {_GMM}, g AS (SELECT vec.label AS grp, pos.k, vec.c AS i, sum(p * (v - m) / sqrt(s)) AS u, sum(p * ((v - m) * (v - m) / s - 1)) AS w FROM pos JOIN vec USING (id) JOIN mod ON mod.k = pos.k AND mod.c = vec.c WHERE p >= 1e-6 GROUP BY 1, 2, 3),
n AS (SELECT label AS grp, count(*) AS n FROM embeddings GROUP BY 1)
SELECT grp, k, 0 AS part, i, round(u / (n * sqrt(0.1::DOUBLE)), 5) + 0.0 AS v FROM g JOIN n USING (grp) UNION ALL SELECT grp, k, 1, i, round(w / (n * sqrt(0.2::DOUBLE)), 5) + 0.0 FROM g JOIN n USING (grp)""")
def fisher(spark, d):
    rows = I.vectors(spark, d).withColumnRenamed("label", "grp")
    return encode.fisher(rows, _modes(spark, d), "grp").select("grp", "k", "part", "i", (F.round("v", 5) + 0.0).alias("v"))


@query("vlad", f"""WITH {_ASG}, s AS (SELECT vec.label AS grp, asg.k, vec.c AS i, sum(v) - count(*) * min(m) AS v FROM asg JOIN vec USING (id) JOIN cen ON cen.k = asg.k AND cen.c = vec.c GROUP BY 1, 2, 3),
q AS (SELECT grp, k, i, sign(v) * sqrt(abs(v)) AS v FROM s), p AS (SELECT grp, k, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY grp, k)), 1e-12) AS v FROM q)
SELECT grp, k, i, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY grp)), 1e-12), 4) + 0.0 AS v FROM p""")
def vlad(spark, d):
    rows = I.vectors(spark, d)
    at = rows.join(nearest_centre(rows, I.centres(spark, d)).select("id", "k"), "id").withColumnRenamed("label", "grp")
    return encode.residuals(at, I.centres(spark, d), "grp", square_root=True, normalise_parts=True).select("grp", "k", "i", (F.round("v", 4) + 0.0).alias("v"))


@query("bow_hist", f"WITH {_ASG}, g AS (SELECT DISTINCT label AS grp FROM embeddings) SELECT grp, CAST(w AS INT) AS k, (SELECT count(*) FROM asg JOIN embeddings ON vec_id = id WHERE label = grp AND asg.k = w) AS n FROM g, range(10) t(w)")
def bow_hist(spark, d):
    rows = I.vectors(spark, d)
    at = nearest_centre(rows, I.centres(spark, d)).join(rows.select("id", F.col("label").alias("grp")), "id")
    return encode.bag_of_words(at, "grp", 10)


@query("pca_apply", f"WITH {I.VEC}, u AS (SELECT CAST(k AS INT) AS k, c, CASE WHEN c % 2 = k THEN 0.125::DOUBLE ELSE -0.125 END AS u FROM range(2) a(k), range(64) b(c)) SELECT id, k, round(sum((v - 0.01) * u), 6) + 0.0 AS v FROM vec JOIN u USING (c) GROUP BY id, k")
def pca_apply(spark, d):
    comp = spark.createDataFrame([(k, [0.125 if c % 2 == k else -0.125 for c in range(64)]) for k in range(2)], "k int, u array<double>")
    return encode.project(I.vectors(spark, d), comp, [0.01] * 64).select("id", "k", (r6("v") + 0.0).alias("v"))


@query("svm_losses", f"WITH {I.SCORED}, m AS (SELECT label, score / 100 AS s, label * score / 100 AS m FROM scored) SELECT label, round(sum(greatest(0, 1 - m)), 4) AS hinge, round(sum(greatest(0, 1 - m) * greatest(0, 1 - m)), 4) AS hinge2, round(sum(abs(label - s)), 4) AS l1, round(sum((label - s) * (label - s)), 4) AS l2, round(sum(ln(1 + exp(-m))), 4) AS logistic FROM m GROUP BY label")
def svm_losses(spark, d):
    ls = encode.losses(F.col("label"), F.col("score") / 100)
    return I.scored(spark, d).groupBy("label").agg(*(F.round(F.sum(c), 4).alias(n) for n, c in ls.items()))


@query("kernel_map", f"""WITH {I.HIST} SELECT id, i - 1 AS i, round(sqrt(v * 0.5), 6) AS f0, CASE WHEN v > 0 THEN round(sqrt(v / cosh(pi() * 0.5)) * cos(ln(v) * 0.5), 6) ELSE 0 END + 0.0 AS f1,
CASE WHEN v > 0 THEN round(sqrt(v / cosh(pi() * 0.5)) * sin(ln(v) * 0.5), 6) ELSE 0 END + 0.0 AS f2 FROM hist""")
def kernel_map(spark, d):
    long = I.histograms(spark, d).select("id", F.posexplode("x").alias("i", "v"))
    f = encode.kernel_map(F.col("v"))
    return long.select("id", "i", *((r6(c) + 0.0).alias(f"f{k}") for k, c in enumerate(f)))


@query("meanshift_step", f"WITH {I.BOXES} SELECT a.id, round(avg(b.x), 6) AS x, round(avg(b.y), 6) AS y FROM box a JOIN box b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 36 GROUP BY a.id")
def meanshift_step(spark, d):
    return cluster.mean_shift_step(I.boxes(spark, d), 6.0).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("flatmap_roots", """WITH RECURSIVE p AS (SELECT CAST(p_partkey AS INT) AS node, CAST(CASE WHEN p_partkey % 50 = 0 OR p_partkey // 2 * 2 = 0 THEN p_partkey ELSE p_partkey // 2 END AS INT) AS parent FROM part),
w(node, cur) AS (SELECT node, parent FROM p UNION SELECT w.node, p.parent FROM w JOIN p ON p.node = w.cur) SELECT w.node, min(w.cur) AS root FROM w GROUP BY w.node""")
def flatmap_roots(spark, d):
    k = F.col("p_partkey")
    half = F.floor(k / 2)
    return cluster.flat_roots(I.table(spark, d, "part").select(k.cast("int").alias("node"), F.when((k % 50 == 0) | (half * 2 == 0), k).otherwise(half).cast("int").alias("parent"))).select("node", "root")


_EDGES = "edges AS (SELECT c_nationkey AS src, s_nationkey AS dst, 1000.0::DOUBLE / count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


@query("shortest_path", f"WITH RECURSIVE {_EDGES}, w(node, dist, n) AS (SELECT 0, 0.0::DOUBLE, 0 UNION ALL SELECT dst, min(dist + e.w), n + 1 FROM w JOIN edges e ON e.src = w.node WHERE n < 12 GROUP BY dst, n + 1) SELECT CAST(node AS INT) AS node, round(min(dist), 6) AS dist FROM w GROUP BY 1")
def shortest_path(spark, d):
    t = lambda n: I.table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg((1000.0 / F.count(F.lit(1))).alias("w"))
    return cluster.shortest_paths(cluster.cut_lineage(edges), 0).select("node", r6("dist").alias("dist"))


@query("quickshift_parent", f"""WITH {I.COUNT_GRID}, e AS (SELECT a.r, a.c, a.v, round(sum(exp(-((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) + (a.v - b.v) * (a.v - b.v)) / 2)), 9) AS e FROM grid a JOIN grid b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY ALL),
u AS (SELECT a.r, a.c, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) + (a.v - b.v) * (a.v - b.v) AS d, b.r AS r2, b.c AS c2 FROM e a JOIN e b ON b.e > a.e AND abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4),
m AS (SELECT r, c, min((d, c2, r2)) AS m FROM u WHERE d <= 16 GROUP BY 1, 2)
SELECT e.r, e.c, round(e, 6) AS density, coalesce(m[3], e.r) AS pr, coalesce(m[2], e.c) AS pc, round(sqrt(m[1]), 6) AS gap FROM e LEFT JOIN m USING (r, c)""")
def quickshift_parent(spark, d):
    return cluster.quick_shift(I.count_grid(spark, d), 1.0, 4.0).select("r", "c", r6("density").alias("density"), "pr", "pc", r6("gap").alias("gap"))


@query("aib_beta", """WITH j AS (SELECT event_type AS val, user_id % 7 AS cls, count(*)::DOUBLE / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1, 2), t AS (SELECT val, sum(p) AS t FROM j GROUP BY 1),
o AS (SELECT val, t, sum(p * ln(p / t)) AS s FROM j JOIN t USING (val) GROUP BY 1, 2),
m AS (SELECT a.val AS a, b.val AS b, sum(x * ln(x)) AS part FROM o a JOIN o b ON a.val < b.val, LATERAL (SELECT sum(p) AS x FROM j WHERE val IN (a.val, b.val) GROUP BY cls) GROUP BY 1, 2)
SELECT m.a, m.b, round((x.t + y.t) * ln(x.t + y.t) + x.s + y.s - part, 6) + 0.0 AS beta FROM m JOIN o x ON x.val = m.a JOIN o y ON y.val = m.b""")
def aib_beta(spark, d):
    e = I.table(spark, d, "events")
    n = e.count()
    joint = e.groupBy(F.col("event_type").alias("val"), (F.col("user_id") % 7).alias("cls")).agg((F.count(F.lit(1)) / n).alias("p"))
    return cluster.information_loss(joint).select("a", "b", (r6("beta") + 0.0).alias("beta"))


# --- trees

_FERNS = [([0, 3, 5], [0.0, 0.02, -0.01]), ([7, 11, 2], [0.01, 0.0, 0.03])]
_LEAF = lambda f, t: "1 + " + " + ".join(f"CASE WHEN CAST(embedding[{a + 1}] AS DOUBLE) < {b} THEN {1 << (2 - k)} ELSE 0 END" for k, (a, b) in enumerate(zip(f, t, strict=True)))


@query("fern_index", f"SELECT vec_id AS id, {_LEAF(*_FERNS[0])} AS leaf FROM embeddings")
def fern_index(spark, d):
    return I.vectors(spark, d).select("id", trees.fern_index(F.col("x"), *_FERNS[0]).alias("leaf"))


_FERN = f"""l AS (SELECT 0 AS fern, {_LEAF(*_FERNS[0])} AS leaf, label AS cls FROM embeddings UNION ALL SELECT 1, {_LEAF(*_FERNS[1])}, label FROM embeddings),
n AS (SELECT f.fern, lf.leaf, k.cls, 1 + (SELECT count(*) FROM l WHERE l.fern = f.fern AND l.leaf = lf.leaf AND l.cls = k.cls) AS n FROM range(2) f(fern), range(1, 9) lf(leaf), (SELECT DISTINCT label AS cls FROM embeddings) k)"""


@query("fern_train", f"WITH {_FERN} SELECT CAST(fern AS INT) AS fern, CAST(leaf AS INT) AS leaf, cls, round(ln(n / sum(n) OVER (PARTITION BY fern, cls)), 6) AS p FROM n")
def fern_train(spark, d):
    return trees.fern_train(I.vectors(spark, d).withColumnRenamed("label", "cls"), _FERNS).select("fern", "leaf", "cls", r6("p").alias("p"))


@query("fern_apply", f"""WITH {_FERN}, p AS (SELECT fern, leaf, cls, ln(n / sum(n) OVER (PARTITION BY fern, cls)) AS p FROM n),
a AS (SELECT vec_id AS id, 0 AS fern, {_LEAF(*_FERNS[0])} AS leaf FROM embeddings UNION ALL SELECT vec_id, 1, {_LEAF(*_FERNS[1])} FROM embeddings),
s AS (SELECT id, cls, round(sum(p), 9) AS p FROM a JOIN p USING (fern, leaf) GROUP BY 1, 2) SELECT id, arg_min(cls, (-p, cls)) AS cls FROM s GROUP BY id""")
def fern_apply(spark, d):
    rows = I.vectors(spark, d)
    return trees.fern_apply(rows, trees.fern_train(rows.withColumnRenamed("label", "cls"), _FERNS), _FERNS)


_SPLIT = f"""WITH {I.VEC}, n AS (SELECT c AS f, v AS x, label % 3 AS cls, count(*)::DOUBLE AS n FROM vec GROUP BY 1, 2, 3), k AS (SELECT f, x, cls FROM (SELECT DISTINCT f, x FROM n), (SELECT DISTINCT cls FROM n)),
r AS (SELECT f, x, cls, sum(coalesce(n, 0)) OVER (PARTITION BY f, cls ORDER BY x) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY f, cls) AS t, lead(x) OVER (PARTITION BY f, cls ORDER BY x) AS nx FROM k LEFT JOIN n USING (f, x, cls)),
q AS (SELECT f, x, nx, cls, l, t - l AS r FROM r WHERE nx - x >= 1e-6), w AS (SELECT f, x, nx, sum(l) AS wl, sum(r) AS wr FROM q GROUP BY 1, 2, 3), s AS (SELECT f, x, nx, round({{}}, 9) AS score FROM q JOIN w USING (f, x, nx) GROUP BY f, x, nx, wl, wr)
SELECT f, round(arg_min((x + nx) / 2, (score, (x + nx) / 2)), 9) AS threshold, round(min(score), 6) AS score FROM s GROUP BY f"""
_SCORES = {
    "gini": "((wl - sum(l * l) / wl) + (wr - sum(r * r) / wr)) / (wl + wr)",
    "entropy": "(sum(CASE WHEN l > 0 THEN -l * log2(l / wl) ELSE 0 END) + sum(CASE WHEN r > 0 THEN -r * log2(r / wr) ELSE 0 END)) / (wl + wr)",
    "twoing": "-(wl / (wl + wr)) * (wr / (wl + wr)) * sum(abs(l / wl - r / wr)) * sum(abs(l / wl - r / wr))",
}


def _split(kind):
    def run(spark, d):
        rows = I.vectors(spark, d).select((F.col("label") % 3).alias("cls"), F.posexplode("x").alias("f", "x"))
        return trees.best_split(rows, kind).select("f", F.round("threshold", 9).alias("threshold"), r6("score").alias("score"))

    return run


for _k, _s in _SCORES.items():
    query(f"split_{_k}", _SPLIT.format(_s))(_split(_k))


_TREE = [(0, 0.0, 1, 0.0), (3, 0.05, 3, 0.0), (5, -0.02, 5, 0.0), (0, 0, 0, 1.0), (0, 0, 0, -0.5), (0, 0, 0, 0.25), (0, 0, 0, -1.0)]


@query("tree_apply", "SELECT vec_id AS id, CASE WHEN embedding[1] < 0 THEN CASE WHEN CAST(embedding[4] AS DOUBLE) < 0.05 THEN 1.0 ELSE -0.5 END ELSE CASE WHEN CAST(embedding[6] AS DOUBLE) < -0.02 THEN 0.25 ELSE -1.0 END END::DOUBLE AS v FROM embeddings")
def tree_apply(spark, d):
    return I.vectors(spark, d).select("id", trees.boosted(F.col("x"), [_TREE]).alias("v"))


# --- patch fields: the grid of counts against itself, 3 x 3 patches, window 4

_FIELD = f"""{I.COUNT_GRID}, pos AS (SELECT r AS y, c AS x FROM grid WHERE r <= 21 AND c <= 29),
pd AS (SELECT a.y, a.x, b.y AS ty, b.x AS tx, round(sum((s.v - t.v) * (s.v - t.v)) / 9, 9) AS dist FROM pos a JOIN pos b ON abs(a.y - b.y) <= 4 AND abs(a.x - b.x) <= 4 AND NOT (a.y = b.y AND a.x = b.x), range(9) k(k)
JOIN grid s ON s.r = a.y + k // 3 AND s.c = a.x + k % 3 JOIN grid t ON t.r = b.y + k // 3 AND t.c = b.x + k % 3 GROUP BY 1, 2, 3, 4),
fld AS (SELECT y, x, m[2] AS ty, m[3] AS tx, m[1] AS dist FROM (SELECT y, x, min((dist, ty, tx)) AS m FROM pd GROUP BY 1, 2)),
spr AS (SELECT y + k // 3 AS r, x + k % 3 AS c, ty + k // 3 AS tr, tx + k % 3 AS tc, k FROM fld, range(9) k(k))"""


def _field(spark, d):
    g = I.count_grid(spark, d)
    return g, patchfield.search(g, g, 3, 4)


@query("patch_search_exact", f"WITH {_FIELD} SELECT y, x, ty, tx, round(dist, 6) AS dist FROM fld")
def patch_search_exact(spark, d):
    return _field(spark, d)[1].select("y", "x", "ty", "tx", r6("dist").alias("dist"))


@query("occurrence_map", f"WITH {_FIELD} SELECT CAST(tr AS INT) AS r, CAST(tc AS INT) AS c, count(*) AS n FROM spr GROUP BY 1, 2")
def occurrence_map(spark, d):
    return patchfield.occurrences(_field(spark, d)[1], 3)


@query("field_coherence", f"""WITH {_FIELD} SELECT a.y, a.x, count(b.y) AS n FROM fld a LEFT JOIN fld b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.ty - b.ty = a.y - b.y AND a.tx - b.tx = a.x - b.x GROUP BY 1, 2""")
def field_coherence(spark, d):
    return patchfield.coherence(_field(spark, d)[1])


@query("vote_default", f"WITH {_FIELD} SELECT CAST(spr.r AS INT) AS r, CAST(spr.c AS INT) AS c, round(avg(v), 6) AS v, count(*)::DOUBLE AS w FROM spr JOIN grid ON grid.r = tr AND grid.c = tc GROUP BY 1, 2")
def vote_default(spark, d):
    g, f = _field(spark, d)
    return patchfield.vote(f, g, 3).select("r", "c", r6("v").alias("v"), "w")


_W = [1.0, 2.0, 1.0, 2.0, 4.0, 2.0, 1.0, 2.0, 1.0]


@query("vote_weighted", f"WITH {_FIELD}, w AS (SELECT spr.r, spr.c, v, list_value({', '.join(map(str, _W))})[k + 1]::DOUBLE AS w FROM spr JOIN grid ON grid.r = tr AND grid.c = tc) SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(sum(w * v) / sum(w), 6) AS v, sum(w) AS w FROM w GROUP BY 1, 2")
def vote_weighted(spark, d):
    g, f = _field(spark, d)
    return patchfield.vote(f, g, 3, _W).select("r", "c", r6("v").alias("v"), "w")


@query("vote_median", f"WITH {_FIELD} SELECT CAST(spr.r AS INT) AS r, CAST(spr.c AS INT) AS c, quantile_disc(v, 0.5) AS v FROM spr JOIN grid ON grid.r = tr AND grid.c = tc GROUP BY 1, 2")
def vote_median(spark, d):
    g, f = _field(spark, d)
    return patchfield.vote_median(f, g, 3)


@query("vote_direct", f"WITH {_FIELD} SELECT g.r, g.c, t.v FROM grid g JOIN fld f ON f.y = least(g.r, 21) AND f.x = least(g.c, 29) JOIN grid t ON t.r = f.ty + g.r - f.y AND t.c = f.tx + g.c - f.x")
def vote_direct(spark, d):
    g, f = _field(spark, d)
    return patchfield.vote_direct(f, g, g)


@query("vote_both_ways", f"""WITH {_FIELD}, two AS (SELECT r, c, tr, tc, 0.5::DOUBLE AS w FROM spr UNION ALL SELECT tr, tc, r, c, 0.5::DOUBLE FROM spr)
SELECT CAST(two.r AS INT) AS r, CAST(two.c AS INT) AS c, round(sum(w * v) / sum(w), 6) AS v FROM two JOIN grid ON grid.r = tr AND grid.c = tc GROUP BY 1, 2""")
def vote_both_ways(spark, d):
    g, f = _field(spark, d)
    return patchfield.vote_both_ways(f, f, g, 3).select("r", "c", r6("v").alias("v"))


# --- texts, intervals, colours

@query("natural_sort", "SELECT p_brand, dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INT)) AS place, count(*) AS n FROM part GROUP BY p_brand")
def natural_sort(spark, d):
    from pyspark.sql import Window

    brands = I.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return brands.select("p_brand", F.dense_rank().over(Window.orderBy(text.natural_key(F.col("p_brand")))).cast("long").alias("place"), "n")  # one row a brand


@query("zero_padded", "SELECT o_orderkey AS id, CASE WHEN length(o_orderkey::VARCHAR) >= 6 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 6, '0') END AS s FROM orders")
def zero_padded(spark, d):
    return I.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.padded(F.col("o_orderkey"), 6).alias("s"))


@query("wildcard_match", "SELECT c_custkey AS id FROM customer WHERE c_name GLOB '*0?1*'")
def wildcard_match(spark, d):
    return I.table(spark, d, "customer").where(text.wildcard(F.col("c_name"), "*0?1*")).select(F.col("c_custkey").alias("id"))


_RUN = f"WITH {I.RUNS}, b AS (SELECT *, CASE WHEN type = lag(type) OVER (PARTITION BY user_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM ord), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM b)"


@query("behavior_runs", f'{_RUN} SELECT user_id AS stream, CAST(run AS BIGINT) AS run, min(seq) AS start, max(seq) AS "end", type AS kind FROM n GROUP BY 1, 2, 5')
def behavior_runs(spark, d):
    return intervals.runs(I.ordered_events(spark, d), "user_id", "seq", "type")


@query("runs_to_frames", f"WITH {I.RUNS} SELECT user_id AS stream, CAST(seq AS INT) AS frame, type AS kind FROM ord")
def runs_to_frames(spark, d):
    return intervals.frames(intervals.runs(I.ordered_events(spark, d), "user_id", "seq", "type"))


@query("kind_at_frame", f"WITH {I.RUNS} SELECT user_id AS stream, seq AS frame, type AS kind FROM ord")
def kind_at_frame(spark, d):
    o = I.ordered_events(spark, d)
    asked = o.select(F.col("user_id").alias("stream"), F.col("seq").alias("frame"))
    return intervals.kind_at(intervals.runs(o, "user_id", "seq", "type"), asked)


@query("rgb_gray_hsv", """WITH p AS (SELECT p_partkey AS id, (p_partkey % 97) / 96.0::DOUBLE AS r, (p_partkey % 89) / 88.0::DOUBLE AS g, (p_size % 50) / 49.0::DOUBLE AS b FROM part), m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM p)
SELECT id, round(r * 0.2989360213 + g * 0.5870430745 + b * 0.1140209043, 6) AS gray, round(CASE WHEN d = 0 THEN 0 WHEN r = hi THEN ((g - b) / d - 6 * floor((g - b) / d / 6)) WHEN g = hi THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6, 6) AS h, round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 6) AS s, round(hi, 6) AS v FROM m""")
def rgb_gray_hsv(spark, d):
    k = F.col("p_partkey")
    p = I.table(spark, d, "part").select(k.alias("id"), ((k % 97) / 96.0).alias("r"), ((k % 89) / 88.0).alias("g"), ((F.col("p_size") % 50) / 49.0).alias("b"))
    c = [F.col(n) for n in "rgb"]
    h, s, v = colour.hsv(*c)
    return p.select("id", r6(colour.gray(*c)).alias("gray"), r6(h).alias("h"), r6(s).alias("s"), r6(v).alias("v"))


@query("rgb_lab", """WITH p AS (SELECT p_partkey AS id, (p_partkey % 97) / 96.0::DOUBLE AS r, (p_partkey % 89) / 88.0::DOUBLE AS g, (p_size % 50) / 49.0::DOUBLE AS b FROM part),
x AS (SELECT id, (r * 0.430574 + g * 0.341550 + b * 0.178325) / 0.950456 AS x, r * 0.222015 + g * 0.706655 + b * 0.071330 AS y, (r * 0.020183 + g * 0.129553 + b * 0.939180) / 1.088754 AS z FROM p),
f AS (SELECT id, CASE WHEN x > pow(6 / 29.0::DOUBLE, 3) THEN cbrt(x) ELSE x * pow(29 / 6.0::DOUBLE, 2) / 3 + 4 / 29.0::DOUBLE END AS fx, CASE WHEN y > pow(6 / 29.0::DOUBLE, 3) THEN cbrt(y) ELSE y * pow(29 / 6.0::DOUBLE, 2) / 3 + 4 / 29.0::DOUBLE END AS fy, CASE WHEN z > pow(6 / 29.0::DOUBLE, 3) THEN cbrt(z) ELSE z * pow(29 / 6.0::DOUBLE, 2) / 3 + 4 / 29.0::DOUBLE END AS fz FROM x)
SELECT id, round(116 * fy - 16, 5) AS l, round(500 * (fx - fy), 5) AS a, round(200 * (fy - fz), 5) AS b FROM f""")
def rgb_lab(spark, d):
    k = F.col("p_partkey")
    p = I.table(spark, d, "part").select(k.alias("id"), ((k % 97) / 96.0).alias("r"), ((k % 89) / 88.0).alias("g"), ((F.col("p_size") % 50) / 49.0).alias("b"))
    lo = colour.lab(*colour.xyz(*(F.col(n) for n in "rgb")))
    return p.select("id", *(F.round(c, 5).alias(n) for n, c in zip("lab", lo, strict=True)))


@query("running_best", f"WITH {I.RUNS} SELECT event_id AS id FROM ord a WHERE NOT EXISTS (SELECT 1 FROM ord b WHERE a.user_id = b.user_id AND b.value > a.value)")
def running_best(spark, d):
    o = I.ordered_events(spark, d)
    top = o.groupBy("user_id").agg(F.max("value").alias("value"))
    return o.join(top, ["user_id", "value"], "left_semi").select(F.col("event_id").alias("id"))



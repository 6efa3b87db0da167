"""Queries: bins, distances, neighbours, ranked curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bins, metrics, neighbors, ranked
from . import inputs as I
from .registry import query

r6 = lambda c: F.round(c, 6)

# --- distances of all vectors to the few centres

_VEC_SQL = {
    "l2_squared": "sum((v - m) * (v - m))", "euclidean": "sqrt(sum((v - m) * (v - m)))", "l1": "sum(abs(v - m))", "linf": "max(abs(v - m))",
    "l0": "sum(CASE WHEN v <> m THEN 1.0::DOUBLE ELSE 0 END)", "cosine": "greatest(0, 1 - sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))))",
    "kernel_l1": "sum((abs(v) + abs(m) - abs(v - m)) / 2)", "kernel_l2": "sum(v * m)",
}
_JS = "CASE WHEN {a} = 0 THEN 0 ELSE {a} * log2(1 + {b} / {a}) END"
_HIST_SQL = {
    "chi2": "sum(CASE WHEN v + m = 0 THEN 0 ELSE (v - m) * (v - m) / (v + m) END)", "chi2_half": "sum((v - m) * (v - m) / (v + m + power(2::DOUBLE, -52))) / 2",
    "hellinger": "sum(v + m - 2 * sqrt(v * m))", "js": f"sum(v - {_JS.format(a='v', b='m')} + m - {_JS.format(a='m', b='v')})",
    "kernel_chi2": "sum(CASE WHEN v + m = 0 THEN 0 ELSE 2 * v * m / (v + m) END)", "kernel_hellinger": "sum(sqrt(v * m))",
    "kernel_js": f"sum(({_JS.format(a='v', b='m')} + {_JS.format(a='m', b='v')}) / 2)",
}


def _pairs(name, rows, few):
    def run(spark, d):
        both = rows(spark, d).join(F.broadcast(few(spark, d)), F.lit(True))  # a fixed number of centres
        return both.select("id", "k", r6(metrics.METRICS[name](F.col("x"), F.col("c"))).alias("d"))

    return run


for _n, _sql in _VEC_SQL.items():
    query(f"pairwise_{_n}", f"WITH {I.VEC}, {I.CENTRES} SELECT id, k, round({_sql}, 6) AS d FROM vec JOIN cen USING (c) GROUP BY id, k")(_pairs(_n, I.vectors, I.centres))
for _n, _sql in _HIST_SQL.items():
    query(f"pairwise_{_n}", f"WITH {I.HIST}, {I.PROTO} SELECT id, k, round({_sql}, 6) AS d FROM hist JOIN pro USING (i) GROUP BY id, k")(_pairs(_n, I.histograms, I.prototypes))
query(
    "pairwise_emd",
    f"""WITH {I.HIST}, {I.PROTO}, run AS (SELECT id, k, sum(v - m) OVER (PARTITION BY id, k ORDER BY i) AS s FROM hist JOIN pro USING (i))
    SELECT id, k, round(sum(abs(s)), 6) AS d FROM run GROUP BY id, k""",
)(_pairs("emd", I.histograms, I.prototypes))


@query("kernel_metric_identity", f"WITH {I.VEC}, {I.CENTRES} SELECT id, k, round(sum((v - m) * (v - m)), 6) AS d FROM vec JOIN cen USING (c) GROUP BY id, k")
def kernel_metric_identity(spark, d):
    both = I.vectors(spark, d).join(F.broadcast(I.centres(spark, d)), F.lit(True))
    x, c = F.col("x"), F.col("c")
    return both.select("id", "k", r6(metrics.kernel_l2(x, x) + metrics.kernel_l2(c, c) - 2 * metrics.kernel_l2(x, c)).alias("d"))


@query("mahalanobis_to_mean", f"WITH {I.VEC}, st AS (SELECT c, round(avg(v), 6) AS m, round(1 / var_pop(v), 4) AS s FROM vec GROUP BY c) SELECT id, round(sum((v - m) * (v - m) * s), 4) AS d FROM vec JOIN st USING (c) GROUP BY id")
def mahalanobis_to_mean(spark, d):
    st = I.cells(spark, d).groupBy("c").agg(F.round(F.avg("v"), 6).alias("m"), F.round(1 / F.var_pop("v"), 4).alias("s"))
    one = st.agg(F.array_sort(F.collect_list(F.struct("c", "m", "s"))).alias("a")).select(F.transform("a", lambda t: t["m"]).alias("m"), F.transform("a", lambda t: t["s"]).alias("s"))
    return I.vectors(spark, d).crossJoin(F.broadcast(one)).select("id", F.round(metrics.mahalanobis(F.col("x"), F.col("m"), F.col("s")), 4).alias("d"))  # one row


# --- neighbours: queries are the rows whose id 50 divides, against all rows

_NEAR = f"""WITH {I.VEC}, q AS (SELECT id AS query, c, v AS m FROM vec WHERE id % 50 = 0),
d AS (SELECT query, id, sum((v - m) * (v - m)) AS dist FROM vec JOIN q USING (c) WHERE id <> query GROUP BY query, id),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, id) AS place FROM d)"""


@query("knn_l2", f"{_NEAR} SELECT query, id, place, round(dist, 6) AS distance FROM o WHERE place <= 7")
def knn_l2(spark, d):
    v = I.vectors(spark, d)
    return neighbors.top_k(v.where(F.col("id") % 50 == 0), v, 7).select("query", "id", F.col("place").cast("long").alias("place"), r6("distance").alias("distance"))


@query("ratio_match", f"{_NEAR} SELECT a.query, a.id, round(a.dist, 6) AS distance FROM o a JOIN o b ON a.query = b.query AND a.place = 1 AND b.place = 2 WHERE 1.05 * a.dist < b.dist")
def ratio_match(spark, d):
    v = I.vectors(spark, d)
    return neighbors.ratio_match(v.where(F.col("id") % 50 == 0), v, 1.05).select("query", "id", r6("distance").alias("distance"))


@query("kmeans_assign", f"""WITH {I.VEC}, {I.CENTRES}, d AS (SELECT id, k, sum((v - m) * (v - m)) AS dist FROM vec JOIN cen USING (c) GROUP BY id, k)
SELECT id, arg_min(k, (dist, k)) AS k, round(min(dist), 6) AS distance FROM d GROUP BY id""")
def kmeans_assign(spark, d):
    return neighbors.nearest_centre(I.vectors(spark, d), I.centres(spark, d)).select("id", "k", r6("distance").alias("distance"))


@query("soft_assign", f"""WITH {I.VEC}, {I.CENTRES}, d AS (SELECT id, k, exp(-sum((v - m) * (v - m)) / 0.25) AS e FROM vec JOIN cen USING (c) GROUP BY id, k)
SELECT id, k, round(e / sum(e) OVER (PARTITION BY id), 6) AS share FROM d""")
def soft_assign(spark, d):
    from ..functions.math import soft_min

    both = I.vectors(spark, d).join(F.broadcast(I.centres(spark, d)), F.lit(True)).select("id", "k", metrics.squared(F.col("x"), F.col("c")).alias("d"))
    return soft_min(both, "id", "k", "d", 0.5).select("id", "k", r6("share").alias("share"))


@query("rbf_features", f"WITH {I.VEC}, {I.CENTRES} SELECT id, k, round(exp(-sum((v - m) * (v - m)) / (2 * 0.5)), 6) AS f FROM vec JOIN cen USING (c) GROUP BY id, k")
def rbf_features(spark, d):
    both = I.vectors(spark, d).join(F.broadcast(I.centres(spark, d)), F.lit(True))
    return both.select("id", "k", r6(F.exp(-metrics.squared(F.col("x"), F.col("c")) / (2 * 0.5))).alias("f"))


# --- bins

_EDGES = [0.0, 5.0, 10.0, 20.0, 30.0, 50.0]
_SEARCH = lambda x: " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in _EDGES)


@query("binsearch", f"SELECT CAST({_SEARCH('l_quantity')} AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def binsearch(spark, d):
    return I.weighted(spark, d).groupBy(bins.bin_search(F.col("x"), _EDGES).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("binsum", "SELECT CAST(l_linenumber % 5 AS INT) AS bin, round(sum(l_quantity), 4) AS value FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY 1")
def binsum(spark, d):
    return bins.bin_sum(I.table(spark, d, "lineitem").withColumn("b", (F.col("l_linenumber") % 5).cast("int")), "b", "l_quantity").select("bin", F.round("value", 4).alias("value"))


@query("whistc", f"SELECT CAST({_SEARCH('l_quantity')} AS INT) AS bin, round(sum(l_extendedprice), 2) AS weight FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def whistc(spark, d):
    return bins.weighted_histogram(I.weighted(spark, d), "x", "w", _EDGES).select("bin", F.round("weight", 2).alias("weight"))


@query("histc2_1d", f"WITH b AS (SELECT least({_SEARCH('l_quantity')}, 5) AS bin_x FROM lineitem WHERE l_quantity BETWEEN 0 AND 50) SELECT CAST(bin_x AS INT) AS bin_x, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY bin_x")
def histc2_1d(spark, d):
    return bins.normalised_histogram(I.weighted(spark, d), {"x": _EDGES}).select("bin_x", F.round("share", 9).alias("share"))


@query("histc2_2d", f"""WITH b AS (SELECT CAST(least({_SEARCH('l_quantity')}, 5) AS INT) AS bin_x, CAST(least(CASE WHEN l_tax >= 0 THEN 1 ELSE 0 END + CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END + CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END, 2) AS INT) AS bin_l_tax, l_extendedprice AS w
FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_tax BETWEEN 0 AND 0.08) SELECT bin_x, bin_l_tax, round(sum(w) / sum(sum(w)) OVER (), 9) AS share FROM b GROUP BY 1, 2""")
def histc2_2d(spark, d):
    rows = I.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), "l_tax", F.col("l_extendedprice").alias("w"))
    return bins.normalised_histogram(rows, {"x": _EDGES, "l_tax": [0.0, 0.04, 0.08]}, "w").select("bin_x", "bin_l_tax", F.round("share", 9).alias("share"))


@query("assign_bins", f"SELECT CAST(CASE WHEN l_quantity > 40 THEN 0 ELSE least({' + '.join(f'CASE WHEN l_quantity >= {e} THEN 1 ELSE 0 END' for e in (2, 10, 40))}, 2) END AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def assign_bins(spark, d):
    return I.weighted(spark, d).groupBy(bins.assign_to_bins(F.col("x"), [2, 10, 40]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("hash_count", "SELECT l_linenumber AS a, CAST(l_suppkey % 7 AS INT) AS b, count(*) AS n FROM lineitem WHERE l_linenumber <> 0 OR l_suppkey % 7 <> 0 GROUP BY 1, 2")
def hash_count(spark, d):
    return bins.hash_count(I.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 7).cast("int").alias("b")), ["a", "b"])


@query("hash_find", "WITH h AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey <> 0 GROUP BY 1) SELECT c_custkey AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN h ON k = c_custkey")
def hash_find(spark, d):
    h = bins.hash_count(I.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])
    return bins.hash_find(h, I.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("hist_marginal", "SELECT l_returnflag AS a, count(*) AS n FROM lineitem GROUP BY 1")
def hist_marginal(spark, d):
    h = I.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return bins.marginal(h, ["a"], "n")


@query("normalise_minmax", "SELECT p_partkey AS id, round(1 + (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS scaled FROM part")
def normalise_minmax(spark, d):
    return bins.rescaled(I.boxes(spark, d), "score", 1.0, 2.0).select("id", F.round("scaled", 9).alias("scaled"))


@query("labelize", "SELECT p_partkey AS id, CAST(floor((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()) * 7 + 0.5) + 1 AS INT) AS lbl FROM part")
def labelize(spark, d):
    return bins.labelled(I.boxes(spark, d), "w", 8, 1).select("id", "lbl")


@query("otsu_threshold", """WITH s AS (SELECT (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS s FROM events),
h AS (SELECT CAST(least(floor(s * 256), 255) AS INT) AS b, count(*)::DOUBLE AS n FROM s GROUP BY 1),
c AS (SELECT b, sum(n) OVER (ORDER BY b) AS w0, sum(n * b) OVER (ORDER BY b) AS m0, sum(n) OVER () AS w, sum(n * b) OVER () AS m FROM h),
v AS (SELECT b, w0 / w * (w - w0) / w * (m0 / w0 - (m - m0) / (w - w0)) * (m0 / w0 - (m - m0) / (w - w0)) AS between_ FROM c WHERE w > w0)
SELECT b AS threshold_bin, round(between_, 4) AS between_classes FROM v ORDER BY round(between_, 9) DESC, b LIMIT 1""")
def otsu_threshold(spark, d):
    return bins.otsu(I.table(spark, d, "events").select("value"), "value").select("threshold_bin", F.round("between", 4).alias("between_classes"))


# --- ranked evaluation

_TP = f"""WITH {I.SCORED}, t AS (SELECT count(*) FILTER (WHERE label > 0) AS p, count(*) FILTER (WHERE label < 0) AS n FROM scored),
c AS (SELECT id, label, score, row_number() OVER w AS rank, count(*) FILTER (WHERE label > 0) OVER w AS tp, count(*) FILTER (WHERE label < 0) OVER w AS fp, p, n FROM scored, t
WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"""


@query("tpfp", f"{_TP} SELECT id, rank, tp, fp FROM c")
def tpfp(spark, d):
    return ranked.counts(I.scored(spark, d)).select("id", "rank", "tp", "fp")


@query("roc_curve", f"{_TP} SELECT id, rank, round(tp / greatest(p, 1e-10), 6) AS tpr, round(1 - fp / greatest(n, 1e-10), 6) AS tnr FROM c")
def roc_curve(spark, d):
    return ranked.roc(I.scored(spark, d)).select("id", "rank", r6("tpr").alias("tpr"), r6("tnr").alias("tnr"))


@query("roc_auc", f"{_TP} SELECT round(sum(CASE WHEN label < 0 THEN tp / greatest(p, 1e-10) / greatest(n, 1e-10) ELSE 0 END), 6) AS auc FROM c")
def roc_auc(spark, d):
    return ranked.roc_summary(I.scored(spark, d)).select(r6("auc").alias("auc"))


@query("roc_eer", f"""{_TP}, r AS (SELECT rank, tp::DOUBLE / p AS tpr, 1 - fp::DOUBLE / n AS tnr FROM c UNION ALL SELECT 0, 0, 1),
s AS (SELECT max(rank) AS s FROM r WHERE tnr > tpr)
SELECT round(CASE WHEN a.tpr = b.tpr THEN 1 - a.tpr ELSE 1 - a.tnr END, 6) AS eer FROM s JOIN r a ON a.rank = s LEFT JOIN r b ON b.rank = s + 1""")
def roc_eer(spark, d):
    return ranked.roc_summary(I.scored(spark, d)).select(r6("eer").alias("eer"))


@query("pr_curve", f"{_TP} SELECT id, rank, round(greatest(tp, 1e-10) / greatest(tp + fp, 1e-10), 6) AS precision, round(tp / greatest(p, 1e-10), 6) AS recall FROM c")
def pr_curve(spark, d):
    return ranked.pr(I.scored(spark, d)).select("id", "rank", r6("precision").alias("precision"), r6("recall").alias("recall"))


_PR = f"""{_TP}, r AS (SELECT rank, greatest(tp, 1e-10) / greatest(tp + fp, 1e-10) AS pr, tp / greatest(p, 1e-10) AS rc, p FROM c UNION ALL SELECT 0, 1, 0, p FROM t),
l AS (SELECT *, lag(pr) OVER (ORDER BY rank) AS pr0, lag(rc) OVER (ORDER BY rank) AS rc0 FROM r)"""


@query("pr_auc", f"{_PR} SELECT round(sum((pr + pr0) / 2 * (rc - rc0)), 6) AS auc FROM l")
def pr_auc(spark, d):
    return ranked.pr_summary(I.scored(spark, d)).select(r6("auc").alias("auc"))


@query("pr_ap", f"{_PR} SELECT round(sum(CASE WHEN rc > rc0 THEN pr ELSE 0 END) / max(p), 6) AS ap FROM l")
def pr_ap(spark, d):
    return ranked.pr_summary(I.scored(spark, d)).select(r6("ap").alias("ap"))


@query("pr_ap11", f"{_PR} SELECT round(sum(m) / 11, 6) AS ap11 FROM (SELECT coalesce(max(pr) FILTER (WHERE rc >= k / 10.0::DOUBLE), 0) AS m FROM r, range(11) g(k) GROUP BY k)")
def pr_ap11(spark, d):
    return ranked.pr_summary(I.scored(spark, d)).select(r6("ap11").alias("ap11"))


@query("det_curve", f"{_TP} SELECT id, rank, round(1 - tp / greatest(p, 1e-10), 6) AS miss, round(fp / greatest(n, 1e-10), 6) AS false_alarm FROM c")
def det_curve(spark, d):
    return ranked.det(I.scored(spark, d)).select("id", "rank", r6("miss").alias("miss"), r6("false_alarm").alias("false_alarm"))


@query("confusion", "SELECT l_returnflag AS truth, l_linestatus AS guess, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2")
def confusion(spark, d):
    return ranked.confusion(I.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select("truth", "guess", "n", r6("share").alias("share"))


@query("weighted_median", """WITH s AS (SELECT l_returnflag AS g, l_quantity AS x, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT g, x, sum(w) OVER (PARTITION BY g ORDER BY x) AS c, sum(w) OVER (PARTITION BY g) AS t FROM s) SELECT g, min(x) AS median FROM c WHERE c * 2 > t GROUP BY g""")
def weighted_median(spark, d):
    return ranked.weighted_median(I.weighted(spark, d), "g", "x", "w")

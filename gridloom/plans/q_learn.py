"""Queries: linear machines, seeding, whole-number k-means, merged words, small systems, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linear, text
from ..functions import svm as fs
from ..operators import aib, quantise, svm
from . import inputs as I
from .q_models import _ASG
from .registry import query

r6 = lambda c: F.round(c, 6)

_ROW = f"WITH RECURSIVE {I.SCORED}, t AS (SELECT id, label, score / 100 AS s, -label * (id % 11) / 10.0::DOUBLE AS u, label * (id % 11) / 10.0::DOUBLE AS a, (1 + id % 7)::DOUBLE AS q FROM scored)"


def _rows(spark, d):
    k, y = F.col("id") % 11 / 10.0, F.col("label")
    return I.scored(spark, d).select("id", "label", (F.col("score") / 100).alias("s"), (-y * k).alias("u"), (y * k).alias("a"), (1 + F.col("id") % 7).cast("double").alias("q"))


def _by_label(spark, d, made):
    return _rows(spark, d).groupBy("label").agg(*(F.round(F.sum(made(n)), 4).alias(n) for n in fs.LOSSES))


@query("svm_derivatives", f"""{_ROW} SELECT label, round(sum(CASE WHEN label * s < 1 THEN -label ELSE 0 END)::DOUBLE, 4) AS hinge, round(sum(CASE WHEN label * s < 1 THEN 2 * (s - label) ELSE 0 END), 4) AS hinge2,
round(sum(CASE WHEN label > s THEN -1 ELSE 1 END)::DOUBLE, 4) AS l1, round(sum(-2 * (label - s)), 4) AS l2, round(sum(label * (1 / (1 + exp(-label * s)) - 1)), 4) AS logistic FROM t GROUP BY 1""")
def svm_derivatives(spark, d):
    return _by_label(spark, d, lambda n: fs.derivative(n, F.col("s"), F.col("label")))


@query("svm_conjugates", f"""{_ROW} SELECT label, round(sum(label * u), 4) AS hinge, round(sum((label + u / 4) * u), 4) AS hinge2, round(sum(label * u), 4) AS l1, round(sum((label + u / 4) * u), 4) AS l2,
round(sum(CASE WHEN 1 + label * u > 1e-10 THEN (1 + label * u) * ln(1 + label * u) ELSE 0 END + CASE WHEN -label * u > 1e-10 THEN -label * u * ln(-label * u) ELSE 0 END), 4) AS logistic FROM t GROUP BY 1""")
def svm_conjugates(spark, d):
    return _by_label(spark, d, lambda n: fs.conjugate(n, F.col("u"), F.col("label")))


@query("svm_dual_steps", f"""{_ROW}, h(id, lo, hi, n) AS (SELECT id, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM t UNION ALL SELECT id, CASE WHEN g > 0 THEN mid ELSE lo END, CASE WHEN g > 0 THEN hi ELSE mid END, n + 1
FROM (SELECT h.*, (lo + hi) / 2 AS mid, -ln(((lo + hi) / 2) / (1 - (lo + hi) / 2)) - label * s - q * ((lo + hi) / 2 - label * a) AS g FROM h JOIN t USING (id)) WHERE n < {fs.HALVINGS})
SELECT label, round(sum(label * greatest(0, least(1, label * ((label - s) / q + a))) - a), 4) AS hinge, round(sum(label * greatest(0, label * ((label - s - a / 2) / (q + 0.5) + a)) - a), 4) AS hinge2,
round(sum(greatest(-1, least(1, (label - s) / q + a)) - a), 4) AS l1, round(sum((label - s - a / 2) / (q + 0.5)), 4) AS l2, round(sum(label * (lo + hi) / 2 - a), 4) AS logistic FROM t JOIN h USING (id) WHERE n = {fs.HALVINGS} GROUP BY 1""")
def svm_dual_steps(spark, d):
    return _by_label(spark, d, lambda n: fs.dual_step(n, F.col("a"), F.col("s"), F.col("q"), F.col("label")))


def _machine(spark, d):
    return I.vectors(spark, d).select("id", "x", F.when(F.col("label") == 0, 1).otherwise(-1).alias("y"))


def _descent(epochs: int, lam: float) -> str:
    sql = f"WITH {I.VEC}, x AS (SELECT id, c, v FROM vec UNION ALL SELECT DISTINCT id, -1, 1.0::DOUBLE FROM vec), y AS (SELECT DISTINCT id, CASE WHEN label = 0 THEN 1 ELSE -1 END AS y FROM vec), w0 AS (SELECT DISTINCT c, 0.0::DOUBLE AS w FROM x)"
    for t in range(epochs):
        rate = 1 / (lam * (t + 1))
        sql += f""", b{t} AS (SELECT id, CASE WHEN y * sum(v * w) < 1 THEN -y ELSE 0 END AS b FROM x JOIN w{t} USING (c) JOIN y USING (id) GROUP BY id, y),
g{t} AS (SELECT c, sum(b * v) / count(*) AS g FROM x JOIN b{t} USING (id) GROUP BY c), w{t + 1} AS (SELECT c, w - {rate!r}::DOUBLE * ({lam}::DOUBLE * w + g) AS w FROM w{t} JOIN g{t} USING (c))"""
    return f"{sql} SELECT CAST(c AS INT) AS i, round(w, 6) AS w FROM w{epochs}"


@query("svm_gradient", _descent(3, 0.1))
def svm_gradient(spark, d):
    m = svm.train(_machine(spark, d), "sgd", lam=0.1, epochs=3)
    return spark.createDataFrame([(-1, m.b), *enumerate(m.w)], "i int, w double").select("i", r6("w").alias("w"))


# no SQL: rows are visited one after another in each partition
@query("svm_dual_ascent")
def svm_dual_ascent(spark, d):
    m = svm.train(_machine(spark, d), "sdca", loss="hinge", lam=0.01, epochs=5)
    return spark.createDataFrame([(r["round"], r["objective"], r["dual"]) for r in m.rounds], "round int, objective double, dual double")


@query("svm_scores", f"WITH {I.VEC} SELECT id, round(sum(v * ((c % 5) - 2)) + 0.25, 6) AS score FROM vec GROUP BY id")
def svm_scores(spark, d):
    return I.vectors(spark, d).select("id", r6(svm.inner_product(F.col("x"), [i % 5 - 2.0 for i in range(64)], 0.125, 2.0)).alias("score"))


_DRAW = lambda n: f"(((id * 7919 + {n * 104729 + 12345}) * 48271 % 2147483647 + 1) / 2147483648::DOUBLE)"
_ID = f"{I.VEC}, i AS (SELECT DISTINCT id FROM vec)"


def _components(centres):
    return centres.select(F.col("k").cast("int").alias("k"), F.posexplode("c").alias("i", "v")).select("k", "i", r6("v").alias("v"))


@query("random_centres", f"WITH {_ID}, s AS (SELECT id, CAST(row_number() OVER (ORDER BY {_DRAW(0)}, id) - 1 AS INT) AS k FROM i) SELECT k, CAST(c AS INT) AS i, round(v, 6) AS v FROM s JOIN vec USING (id) WHERE k < 5")
def random_centres(spark, d):
    return _components(quantise.random_centres(I.vectors(spark, d), 5))


_AWAY = lambda s: f"SELECT a.id, sum((a.v - b.v) * (a.v - b.v)) AS d FROM vec a JOIN (SELECT c, v FROM vec JOIN {s} USING (id)) b USING (c) GROUP BY a.id"


@query("spread_centres", f"""WITH {_ID}, s0 AS (SELECT id FROM i ORDER BY {_DRAW(0)}, id LIMIT 1), d0 AS ({_AWAY("s0")}), s1 AS (SELECT id FROM d0 WHERE d > 0 ORDER BY -ln({_DRAW(1)}) / d, id LIMIT 1),
e1 AS ({_AWAY("s1")}), d1 AS (SELECT id, least(d0.d, e1.d) AS d FROM d0 JOIN e1 USING (id)), s2 AS (SELECT id FROM d1 WHERE d > 0 ORDER BY -ln({_DRAW(2)}) / d, id LIMIT 1)
SELECT k, CAST(c AS INT) AS i, round(v, 6) AS v FROM vec JOIN (SELECT 0 AS k, id FROM s0 UNION ALL SELECT 1, id FROM s1 UNION ALL SELECT 2, id FROM s2) USING (id)""")
def spread_centres(spark, d):
    return _components(quantise.spread_centres(I.vectors(spark, d), 3))


@query("random_modes", f"WITH {_ID}, s AS (SELECT id, CAST(row_number() OVER (ORDER BY {_DRAW(0)}, id) - 1 AS INT) AS k FROM i), a AS (SELECT c, greatest(0.0001, var_pop(v)) AS s FROM vec GROUP BY c) SELECT k, CAST(c AS INT) AS i, round(v, 6) AS m, round(a.s, 6) AS s, 0.25::DOUBLE AS prior FROM s JOIN vec USING (id) JOIN a USING (c) WHERE k < 4")
def random_modes(spark, d):
    m = quantise.random_modes(I.vectors(spark, d), 4)
    long = m.select(F.col("k").cast("int").alias("k"), "prior", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "z"))
    return long.select("k", "i", r6("z.mean").alias("m"), r6("z.variance").alias("s"), "prior")


@query("cluster_modes", f"WITH {_ASG}, n AS (SELECT k, count(*) AS n FROM asg GROUP BY k) SELECT asg.k, CAST(c AS INT) AS i, round(avg(v), 6) AS m, round(greatest(0.0001, var_pop(v)), 6) AS s, round(any_value(n.n) / (SELECT count(*) FROM asg)::DOUBLE, 6) AS prior FROM asg JOIN vec USING (id) JOIN n ON n.k = asg.k GROUP BY 1, 2")
def cluster_modes(spark, d):
    m = quantise.modes_of(I.vectors(spark, d), I.centres(spark, d))
    long = m.select("k", "prior", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "z"))
    return long.select("k", "i", r6("z.mean").alias("m"), r6("z.variance").alias("s"), r6("prior").alias("prior"))


def _bytes(spark, d):
    return I.vectors(spark, d).select("id", F.transform("x", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 1) * 128))).cast("bigint")).alias("x"))


_BYTES = "q0 AS (SELECT 0::BIGINT AS node, id, c, CAST(least(255, greatest(0, floor((v + 1) * 128))) AS BIGINT) AS x FROM vec)"


def _lloyd(at: str, to: str, k: int, rounds: int) -> str:
    """SQL of whole-number k-means in the nodes of table ``at``: table ``to`` (node, id, k, d)."""
    nearest = lambda c: f"SELECT node, id, k, d FROM (SELECT {at}.node, {at}.id, k, sum((x - m) * (x - m)) AS d, row_number() OVER (PARTITION BY {at}.id ORDER BY sum((x - m) * (x - m)), k) AS n FROM {at} JOIN {c} USING (node, c) GROUP BY 1, 2, 3) WHERE n = 1"
    sql = f", {to}c0 AS (SELECT node, k, c, x AS m FROM {at} JOIN (SELECT node, id, row_number() OVER (PARTITION BY node ORDER BY {_DRAW(0)}, id) - 1 AS k FROM (SELECT DISTINCT node, id FROM {at})) USING (node, id) WHERE k < {k})"
    for t in range(rounds):
        sql += f", {to}a{t} AS ({nearest(f'{to}c{t}')}), {to}m{t} AS (SELECT node, k, c, sum(x) // count(*) AS m FROM {at} JOIN {to}a{t} USING (node, id) GROUP BY 1, 2, 3), {to}c{t + 1} AS (SELECT o.node, o.k, o.c, coalesce(n.m, o.m) AS m FROM {to}c{t} o LEFT JOIN {to}m{t} n USING (node, k, c))"
    return f"{sql}, {to} AS ({nearest(f'{to}c{rounds}')})"


@query("whole_kmeans", f"WITH {I.VEC}, {_BYTES}{_lloyd('q0', 'l', 4, 2)} SELECT id, CAST(k AS INT) AS k, CAST(d AS BIGINT) AS distance FROM l")
def whole_kmeans(spark, d):
    rows = _bytes(spark, d).withColumn("node", F.lit(0).cast("bigint"))
    return quantise.whole_assign(rows, quantise.whole_kmeans(rows, 4, 2)).select("id", F.col("k").cast("int").alias("k"), "distance")


@query("kmeans_tree", f"""WITH {I.VEC}, {_BYTES}{_lloyd('q0', 'l', 3, 2)}, q1 AS (SELECT l.node * 3 + 1 + k AS node, id, c, x FROM q0 JOIN l USING (id)){_lloyd('q1', 'm', 3, 2)}
SELECT m.id, CAST(m.node AS BIGINT) AS n1, CAST(m.node * 3 + 1 + m.k AS BIGINT) AS n2 FROM m""")
def kmeans_tree(spark, d):
    rows = _bytes(spark, d)
    return quantise.push(rows, quantise.hierarchy(rows, 3, 2, 2), 3).select("id", F.get("path", F.lit(0)).alias("n1"), F.get("path", F.lit(1)).alias("n2"))


def _heap(spark):
    """A tree over 16 words: each node of a level has two below it."""
    return spark.range(31).select(F.col("id").alias("node"), F.when(F.col("id") < 30, 16 + F.floor(F.col("id") / 2)).alias("parent"))


_CUT = "WITH RECURSIVE up(word, node) AS (SELECT i, i FROM range(16) t(i) UNION ALL SELECT word, 16 + node // 2 FROM up WHERE 16 + node // 2 <= 26), c AS (SELECT word, max(node) AS node FROM up GROUP BY 1), k AS (SELECT word, node, CAST(dense_rank() OVER (ORDER BY node) AS INT) AS cluster FROM c)"


@query("aib_cut", f"{_CUT} SELECT word::BIGINT AS word, node::BIGINT AS node, cluster FROM k")
def aib_cut(spark, d):
    return aib.cut(_heap(spark), 16, 5)


def _words(spark, d):
    return I.table(spark, d, "events").select("event_id", (F.col("user_id") % 18).alias("word"))


@query("aib_push", f"{_CUT} SELECT event_id, cluster FROM events LEFT JOIN k ON k.word = user_id % 18")
def aib_push(spark, d):
    return aib.push(_words(spark, d), aib.cut(_heap(spark), 16, 5)).select("event_id", "cluster")


@query("aib_cut_hist", f"{_CUT} SELECT cluster, count(*) AS n FROM events JOIN k ON k.word = user_id % 18 GROUP BY 1")
def aib_cut_hist(spark, d):
    return aib.cut_histogram(_words(spark, d), aib.cut(_heap(spark), 16, 5), 5)


@query("aib_tree_hist", "WITH RECURSIVE up(word, node) AS (SELECT i, i FROM range(16) t(i) UNION ALL SELECT word, 16 + node // 2 FROM up WHERE node < 30) SELECT node::BIGINT AS node, count(event_id) AS n FROM up LEFT JOIN events ON word = user_id % 18 GROUP BY 1")
def aib_tree_hist(spark, d):
    return aib.tree_histogram(_words(spark, d), _heap(spark))


# no SQL: each merge depends on all before; held against plain merging in the tests
@query("aib_tree")
def aib_tree(spark, d):
    n = I.table(spark, d, "events").groupBy((F.col("user_id") % 24).alias("word"), F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return aib.tree(n)[0]


# an irrational factor, as short decimals end in ties of the last digit shown
_SYS = "WITH s AS (SELECT event_id AS id, (event_id % 7 + 1)::DOUBLE AS a, (event_id % 5)::DOUBLE AS b, (event_id % 3)::DOUBLE AS c, (event_id % 11 + 9)::DOUBLE AS d, value * sqrt(2) AS p, (user_id % 10)::DOUBLE AS q FROM events)"


def _systems(spark, d):
    e = F.col("event_id")
    return I.table(spark, d, "events").select(e.alias("id"), *((e % m + x).cast("double").alias(n) for n, m, x in (("a", 7, 1), ("b", 5, 0), ("c", 3, 0), ("d", 11, 9))), (F.col("value") * F.sqrt(F.lit(2.0))).alias("p"), (F.col("user_id") % 10).cast("double").alias("q"))


@query("solve2", f"{_SYS} SELECT id, round((p * d - b * q) / nullif(a * d - b * c, 0), 6) AS x, round((a * q - p * c) / nullif(a * d - b * c, 0), 6) AS y FROM s")
def solve2(spark, d):
    x, y = linear.solve2([F.col(n) for n in "abcd"], [F.col("p"), F.col("q")])
    return _systems(spark, d).select("id", r6(x).alias("x"), r6(y).alias("y"))


# a matrix of 3 x 3: ((a, b, c), (b, d, a), (c, a, 20)) x = (p, q, 1)
_D3 = f"{_SYS}, t AS (SELECT *, a * (d * 20 - a * a) - b * (b * 20 - a * c) + c * (b * a - d * c) AS det FROM s)"
_X3 = "SELECT id, round((p * (d * 20 - a * a) - b * (q * 20 - a) + c * (q * a - d)) / nullif(det, 0), 6) AS x, round((a * (q * 20 - a) - p * (b * 20 - a * c) + c * (b - q * c)) / nullif(det, 0), 6) AS y, round((a * (d - q * a) - b * (b - q * c) + p * (b * a - d * c)) / nullif(det, 0), 6) AS z FROM t"
_M3 = "abcbdaca"


@query("solve3", f"{_D3} {_X3}")
def solve3(spark, d):
    x, y, z = linear.solve3([*(F.col(n) for n in _M3), F.lit(20.0)], [F.col("p"), F.col("q"), F.lit(1.0)])
    return _systems(spark, d).select("id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("solve_any", f"{_D3} {_X3}")
def solve_any(spark, d):
    m = F.array(*(F.col(n) for n in _M3), F.lit(20.0))
    s = _systems(spark, d).select("id", linear.solve(m, F.array("p", "q", F.lit(1.0))).alias("s"))
    return s.select("id", *(r6(F.get("s", F.lit(i))).alias(n) for i, n in enumerate("xyz")))


@query("svd2", f"{_SYS} SELECT id, round(sqrt((a + d) * (a + d) + (c - b) * (c - b)) / 2 + sqrt((a - d) * (a - d) + (c + b) * (c + b)) / 2, 6) AS s1, round(sqrt((a + d) * (a + d) + (c - b) * (c - b)) / 2 - sqrt((a - d) * (a - d) + (c + b) * (c + b)) / 2, 6) AS s2, round((atan2((c - b) / 2, (a + d) / 2) + atan2((c + b) / 2, (a - d) / 2)) / 2, 6) AS l FROM s")
def svd2(spark, d):
    m = linear.svd2(*(F.col(n) for n in "abcd"))
    return _systems(spark, d).select("id", r6(m["s1"]).alias("s1"), r6(m["s2"]).alias("s2"), r6(m["left"]).alias("l"))


_PATH = "WITH p AS (SELECT page_id AS id, url, CASE page_id % 4 WHEN 0 THEN 'ascii://' || page_id || '/a.tar.gz' WHEN 1 THEN 'bin://x.y' WHEN 2 THEN url ELSE 'dir/sub/name.' || page_id || '.txt' END AS path FROM pages)"


def _paths(spark, d):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("ascii://"), k.cast("string"), F.lit("/a.tar.gz"))).when(k % 4 == 1, "bin://x.y").when(k % 4 == 2, F.col("url")).otherwise(F.concat(F.lit("dir/sub/name."), k.cast("string"), F.lit(".txt")))
    return I.table(spark, d, "pages").select(k.alias("id"), "url", path.alias("path"))


@query("path_protocol", f"{_PATH} SELECT id, CASE WHEN NOT regexp_matches(path, '^[^:/]*://') THEN 'none' WHEN path LIKE 'ascii://%' THEN 'ascii' WHEN path LIKE 'bin://%' THEN 'binary' ELSE 'unknown' END AS protocol, regexp_replace(path, '^[^:/]*://', '') AS rest FROM p")
def path_protocol(spark, d):
    return _paths(spark, d).select("id", text.protocol(F.col("path")).alias("protocol"), text.without_protocol(F.col("path")).alias("rest"))


@query("path_basename", rf"{_PATH} SELECT id, regexp_extract(path, '[^/]*$') AS b0, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS b1, regexp_replace(regexp_extract(path, '[^/]*$'), '(\.[^.]*){{1,2}}$', '') AS b2 FROM p")
def path_basename(spark, d):
    return _paths(spark, d).select("id", *(text.basename(F.col("path"), n).alias(f"b{n}") for n in range(3)))


@query("path_wildcard", rf"{_PATH} SELECT id, 'img' || id || '*' || id || '.pgm' AS name FROM p")
def path_wildcard(spark, d):
    return _paths(spark, d).select("id", text.fill_wildcard(F.lit("img*\\**.pgm"), F.col("id").cast("string")).alias("name"))


@query("text_places", f"{_PATH} SELECT id, CASE WHEN contains(path, '.') THEN length(path) - strpos(reverse(path), '.') ELSE -1 END AS at, CASE WHEN lower(path) < lower(url) THEN -1 WHEN lower(path) > lower(url) THEN 1 ELSE 0 END AS cmp FROM p")
def text_places(spark, d):
    return _paths(spark, d).select("id", text.last_place(F.col("path"), ".").cast("long").alias("at"), text.compare_caseless(F.col("path"), F.upper("url")).alias("cmp"))

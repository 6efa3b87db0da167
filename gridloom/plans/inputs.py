"""Inputs derived from the driver's tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators._tasks import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, label)"""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a grid: (r, c, v), columns from 0."""
    return vectors(spark, d).select(F.col("id").alias("r"), F.posexplode("x").alias("c", "v"))


VEC = "vec AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def centres(spark: SparkSession, d: str) -> DataFrame:
    """(k, c): mean vector of each label, components rounded to 6 digits."""
    long = vectors(spark, d).select(F.col("label").alias("k"), F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.round(F.avg("v"), 6).alias("m"))
    return long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


CENTRES = "cen AS (SELECT label AS k, c, round(avg(v), 6) AS m FROM vec GROUP BY label, c)"


def histograms(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): each user's shares of event types, types in alphabetical order."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    kinds = e.agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # one row: the event types
    per = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(kinds)).select(F.col("user_id").alias("id"), F.transform("kinds", lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)) / F.col("t")).alias("x"))


HIST = """cnt AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
usr AS (SELECT user_id, sum(n) AS t FROM cnt GROUP BY 1), knd AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
hist AS (SELECT usr.user_id AS id, knd.i, coalesce(cnt.n, 0) / usr.t AS v FROM usr CROSS JOIN knd LEFT JOIN cnt ON cnt.user_id = usr.user_id AND cnt.event_type = knd.event_type)"""


def prototypes(spark: SparkSession, d: str) -> DataFrame:
    """(k, c): mean histogram of the users of each id modulo 5, rounded to 6 digits."""
    long = histograms(spark, d).select((F.col("id") % 5).cast("int").alias("k"), F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.round(F.avg("v"), 6).alias("m"))
    return long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


PROTO = "pro AS (SELECT CAST(id % 5 AS INT) AS k, i, round(avg(v), 6) AS m FROM hist GROUP BY 1, 2)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, score): purchases are positive."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("label"), F.col("value").alias("score"))


SCORED = "scored AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS label, value AS score FROM events)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(img, id, x, y, w, h, score)"""
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 20).alias("img"), k.alias("id"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"), (5 + F.col("p_size")).cast("double").alias("w"), (5 + k % 23).cast("double").alias("h"), F.col("p_retailprice").alias("score"))


BOXES = "box AS (SELECT p_partkey % 20 AS img, p_partkey AS id, (p_partkey % 97)::DOUBLE AS x, (p_partkey % 89)::DOUBLE AS y, (5 + p_size)::DOUBLE AS w, (5 + p_partkey % 23)::DOUBLE AS h, p_retailprice AS score FROM part)"


def count_grid(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, v): events by hour and user modulo 32, 0 where there are none."""
    e = table(spark, d, "events").groupBy(F.hour("ts").alias("r"), (F.col("user_id") % 32).cast("int").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    full = spark.range(24 * 32).select((F.col("id") / 32).cast("int").alias("r"), (F.col("id") % 32).cast("int").alias("c"))
    return full.join(e, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


COUNT_GRID = """full_grid AS (SELECT CAST(i // 32 AS INT) AS r, CAST(i % 32 AS INT) AS c FROM range(768) t(i)),
evg AS (SELECT CAST(hour(ts) AS INT) AS r, CAST(user_id % 32 AS INT) AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2),
grid AS (SELECT full_grid.r, full_grid.c, coalesce(evg.v, 0) AS v FROM full_grid LEFT JOIN evg USING (r, c))"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """(img, h, w, x): prices of 1024 orders each as an image of 32 x 32; missing orders are 0."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 500000).alias("v"))
    per = spread(o.withColumn("img", F.floor(F.col("k") / 1024)), "img").groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct((F.col("k") % 1024).cast("int").alias("p"), "v"))).alias("m"))
    # a look-up goes through the whole map: only for images that lack orders
    some = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0)))
    x = F.when(F.size("m") == 1024, F.transform(F.array_sort(F.map_entries("m")), lambda e: F.coalesce(e["value"], F.lit(0.0)))).otherwise(some)
    return per.select("img", F.lit(32).alias("h"), F.lit(32).alias("w"), x.alias("x"))


IMAGES = """ord AS (SELECT o_orderkey AS k, o_totalprice / 500000 AS v FROM orders), img AS (SELECT DISTINCT k // 1024 AS img FROM ord),
px AS (SELECT img, p // 32 AS y, p % 32 AS x, coalesce(v, 0.0)::DOUBLE AS v FROM img CROSS JOIN range(1024) t(p) LEFT JOIN ord ON k = img * 1024 + p)"""


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """(g, x, w)"""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("w"))


def ordered_events(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, seq, type, value): each user's events in time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", F.row_number().over(w).alias("seq"), F.col("event_type").alias("type"), "value", "event_id")


RUNS = "ord AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS type, value, event_id FROM events)"

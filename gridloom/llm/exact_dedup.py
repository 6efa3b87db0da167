r"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after all of ``[\x20\x09-\x0D]`` is deleted. Rows are grouped by
the length of the normalised text; only rows in groups of two and more are grouped again by a
hash of the prefix, and only those whose prefix group has two and more get their full content
hashed (SHA-256). Of equal texts the one with the most code points stays, then the smallest key.

Cost: two scans; no shuffle carries a text unless the surviving prefix groups are too many to
send to all tasks (then the scan's rows are shuffled by length and prefix once). Group counts are
partial sums, and group results come back by joins that adaptive execution can split, so that one
group may hold any share of the rows.

Defined results: null counts as empty, and all empty texts are equal; null keys come last among
ties; of repeated rows one stays (kept is true once in each group); an empty table gives no rows;
other columns are ignored by :func:`exact_groups` and pass through :func:`drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, few_rows, materialise, release, text_of

#: Code points of the normalised text that the prefix hash reads.
PREFIX = 64
#: Most (length, prefix hash) pairs, or (key, hash) pairs of rows to drop, that are sent to every task.
SENT_PAIRS = 250_000


def normalised(text):
    """text without ASCII white space."""
    for white in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(white), F.lit(""))
    return text


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: key, keep_key, group_size, kept, full_sha256 and the columns in carry.

    full_sha256 is set where the refinement had to read the whole text.
    """
    body = text_of(f"`{text}`")
    also = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(f"`{key}`").alias("key"), F.char_length(body).alias("chars"), normalised(body).alias("norm"), *also)
    cut = [F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head")]

    meta = materialise(rows.select(*cut), "meta")
    lengths = meta.groupBy("len").count().where("count > 1").select("len")
    # prefix groups, only of lengths that occur more than once; they are summed before they are joined
    heads = meta.groupBy("len", "head").count().where("count > 1").join(lengths, "len", "left_semi").select("len", "head", F.lit(True).alias("deep"))
    heads = materialise(heads, "heads")
    if few_rows(heads, SENT_PAIRS):
        heads = F.broadcast(heads)

    found = rows.select("*", *cut).join(heads, ["len", "head"], "left")
    found = materialise(found.select("key", "chars", "len", F.when(F.col("deep"), F.sha2("norm", 256)).alias("full_sha256"), F.monotonically_increasing_id().alias("uid"), *(f"carry_{i}" for i in range(len(carry)))), "found")
    release(meta)

    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("uid").alias("u")))
    deep = found.where("full_sha256 IS NOT NULL")
    # a table of its own: adaptive execution splits a hot group only between two plain exchanges
    groups = materialise(deep.groupBy("len", "full_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = lambda keep, size, kept: ["key", keep.alias("keep_key"), size.alias("group_size"), kept.alias("kept"), "full_sha256", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry))]
    single = found.where("full_sha256 IS NULL").select(*out(F.col("key"), F.lit(1).cast("long"), F.lit(True)))
    grouped = deep.join(groups, ["len", "full_sha256"]).select(*out(F.col("best.k"), F.col("group_size"), F.col("uid") == F.col("best.u")))
    return single.unionByName(grouped)


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that :func:`exact_groups` doesn't keep; same columns.

    Rows are told apart by key and normalised text; of rows alike in both, the longest text stays.
    """
    kept = exact_groups(df, key, text).where("full_sha256 IS NOT NULL")
    marks = kept.groupBy(F.col("key").alias("_gl_key"), F.col("full_sha256").alias("_gl_sha")).agg(F.max("kept").alias("stay"), F.count(F.lit(1)).alias("n"))
    marks = materialise(marks.where("NOT stay OR n > 1"), "gone")
    rows = df.withColumn("_gl_sum", F.sha2(normalised(text_of(f"`{text}`")), 256))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_gl_key")) & (F.col("_gl_sum") == F.col("_gl_sha"))
    gone = marks.select("_gl_key", "_gl_sha")
    out = rows.join(F.broadcast(gone) if few_rows(gone, SENT_PAIRS) else gone, same, "left_anti").drop("_gl_sum")
    again = marks.where("stay").select("_gl_key", "_gl_sha")
    if few_rows(again, 0):
        return out
    twice = rows.join(again, same, "left_semi")
    one = twice.groupBy(f"`{key}`", "_gl_sum").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.char_length(text_of(f"`{text}`"))).alias("_gl_row"))
    return out.unionByName(one.select("_gl_row.*"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, with the digest of every normalised text."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2(normalised(text_of()), 256).alias("text_sha256"))
    return exact_groups(docs, carry=("text_sha256",)).select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

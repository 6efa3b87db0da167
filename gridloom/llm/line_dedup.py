r"""Line dedup: levelled sorted runs of line hashes.

:class:`LineRuns` keeps (hash, number of documents) in runs sorted by hash, like the levels of a
log-structured merge tree, and the keys known to be common beside them. Each new batch is
merge-anti-joined with the common keys, so that those aren't stored again; what is left is added as a
run of its own. When a level holds ``FANOUT`` runs they are merged into one run of the next level. A key
that reaches the threshold in a batch or a merge moves to the common ones, so each row is read again
only when its level is merged. At the end the keys that reach the threshold over all runs join them,
and the lines of the common keys go.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z lower-cased. Keys
are known by 96 bits of hash (xxhash64 and a murmur3 hash).

Batches are anti-joined with the keys that have reached the threshold, not with all
keys of the runs: a key below it must go on being counted.

Cost: one scan hashes each line once and writes (row mark, line hashes), 12 bytes a line, in folders by
part. Batches are some parts each, of about ``BATCH_ROWS`` documents, and read no others; their number, and
with it the levels, grow with the input; the counts, summed before they move, are the largest shuffle of hashes. A second
look joins (document, line number, hash) of that table with the common keys, and the documents that
have any are joined with their line numbers by document. Common lines never meet in one task: counts
are partial sums, and adaptive execution can split the second look or send the common keys to all
tasks by their measured size. Only SQL functions touch rows.

Defined results: null and empty texts have one empty line; keys without code points always stay;
a repeated row counts as a document of its own; null keys of documents work like others; an empty
table gives no rows; other columns are ignored or pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE, documents, materialise, release, text_of

#: Runs of a level that are merged into one of the next level.
FANOUT = 3
#: Parts of the table of hashes: by the task that wrote them, and by a hash. There are no more batches than parts.
TASKS, SPLIT = 1024, 4
#: Documents of a batch in which a table is added, about; there are FANOUT + 1 batches at least.
BATCH_ROWS = 20_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bare(line):
    """line without white space at both ends."""
    return F.trim(line, F.lit(WHITE))


def lowered(line):
    """line with A-Z lower-cased."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def lines_of(text):
    return F.split(text, "\n", -1)


def key_hash(key):
    """Null for a key without code points."""
    return F.when(F.octet_length(key) > 0, F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("c")))


def key_hashes(text):
    """Hashes of the keys of all lines of text. One step a transform, so that each is evaluated once."""
    return F.transform(F.transform(F.transform(lines_of(text), bare), lowered), key_hash)


class LineRuns:
    """Counts of documents by line key, in levelled sorted runs of Parquet files in the shared folder."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = FANOUT):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.levels: list[list[DataFrame]] = []
        self.known: list[DataFrame] = []  # common keys, found one after another; a key may be in several

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def common(self) -> DataFrame:
        """(h, c) of the keys that reach the threshold, each once."""
        found = list(self.known)
        if runs := self.runs():
            totals = reduce(DataFrame.unionByName, runs).groupBy("h", "c").agg(F.sum("n").alias("n"))
            found.append(totals.where(F.col("n") >= self.threshold).select("h", "c"))
        return reduce(DataFrame.unionByName, found).distinct()

    def add(self, keys: DataFrame) -> None:
        """keys: a row (h, c) for each document of the batch and distinct key in it."""
        counts = keys.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
        if self.known:
            counts = counts.join(reduce(DataFrame.unionByName, self.known).hint("merge"), ["h", "c"], "left_anti")
        self._put(0, counts)

    def _put(self, level: int, rows: DataFrame) -> None:
        reached = F.col("n") >= self.threshold
        run = materialise(rows.sortWithinPartitions("h", "c"), f"run{level}")
        found = materialise(run.where(reached).select("h", "c"), "known")
        self.known.append(found)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            below = [x.where(~reached) for x in old]  # the others are known already
            self._put(level + 1, reduce(DataFrame.unionByName, below).groupBy("h", "c").agg(F.sum("n").alias("n")))
            for run in old:
                release(run)
        if len(self.known) > 2 * self.fanout:
            old, self.known = self.known, [materialise(reduce(DataFrame.unionByName, self.known).distinct(), "known")]
            for x in old:
                release(x)

    def drop(self) -> None:
        for run in [*self.runs(), *self.known]:
            release(run)
        self.levels, self.known = [], []


def drop_common_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 10, batches: int | None = None) -> DataFrame:
    """One row per row of df: its columns, n_lines, n_dropped and kept_text."""
    spark = df.sparkSession
    body = text_of(f"`{text}`")
    # a document is known by its key and its text, so that repeated and null keys do no harm
    mark = [F.col(f"`{key}`").alias("_gl_id"), F.xxhash64(body).alias("_gl_a"), F.xxhash64(F.lit(1), body).alias("_gl_b")]
    part = (F.pmod(F.spark_partition_id(), F.lit(TASKS)) * SPLIT + F.pmod("_gl_a", F.lit(SPLIT))).cast("int").alias("_gl_part")
    hashed = materialise(df.select(*mark, key_hashes(body).alias("hashes"), part), "hashed", by="_gl_part")
    batches = min(TASKS * SPLIT, batches or max(FANOUT + 1, -(-hashed.count() // BATCH_ROWS)))
    index = LineRuns(spark, threshold)
    for i in range(batches):
        # a filter of folders: a batch reads its own files only
        batch = hashed.where(F.pmod("_gl_part", F.lit(batches)) == i)
        index.add(batch.select(F.explode(F.array_distinct("hashes")).alias("k")).where("k IS NOT NULL").select("k.h", "k.c"))
    common = materialise(index.common(), "common")
    index.drop()

    hits = hashed.select("_gl_id", "_gl_a", "_gl_b", F.posexplode("hashes").alias("_gl_at", "k")).where("k IS NOT NULL").select("_gl_id", "_gl_a", "_gl_b", "_gl_at", "k.h", "k.c").join(common, ["h", "c"], "left_semi")
    gone = hits.groupBy("_gl_id", "_gl_a", "_gl_b").agg(F.collect_set("_gl_at").alias("_gl_gone"))
    gone = materialise(gone.select(F.col("_gl_id").alias("_gl_id2"), F.col("_gl_a").alias("_gl_a2"), F.col("_gl_b").alias("_gl_b2"), "_gl_gone"), "gone")
    release(hashed)
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    # the text under a name of its own: a column of the caller's may be named like a result
    rows = df.select(*own, *mark, body.alias("_gl_body"))
    rows = rows.join(gone, F.col("_gl_id").eqNullSafe(F.col("_gl_id2")) & (F.col("_gl_a") == F.col("_gl_a2")) & (F.col("_gl_b") == F.col("_gl_b2")), "left")
    lines = lines_of(F.col("_gl_body"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gl_gone"))
    # in an array of one, the lines are a variable of the function and not split again for each i
    chosen = F.get(F.transform(F.array(lines), lambda x: F.transform(stay, lambda i: F.get(x, i))), F.lit(0))
    kept = F.when(F.col("_gl_gone").isNull(), F.col("_gl_body")).otherwise(F.array_join(chosen, "\n"))
    # size() of null is -1 outside ANSI mode
    dropped = F.when(F.col("_gl_gone").isNull(), 0).otherwise(F.size("_gl_gone"))
    n_lines = F.octet_length("_gl_body") - F.octet_length(F.replace("_gl_body", F.lit("\n"), F.lit(""))) + 1
    return rows.select(*own, n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go from all documents."""
    out = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common ON k.key = common.key
GROUP BY doc_id
"""

r"""Document fingerprints by I-Match, with several randomised lexicon subsets.

Terms are words (A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``). The lexicon holds the terms
in a band of inverse document frequency: found in a share of ``LOW`` to ``HIGH`` of all documents.
A document keeps its terms of the lexicon; its distinct terms, sorted, are hashed once for each of
``SUBSETS`` random subsets of the lexicon. Subsets keep from one in two terms down to one in 256, so
that long documents, too, have subsets that an edit leaves alone. The likeness of two fingerprints
is the share of equal hashes among the subsets in which either document has a term; a subset that
keeps one in n terms weighs n, as an edit touches it so much more rarely.

Cost: one scan counts terms (summed in each task; one narrow shuffle of (term, count)). The lexicon
reaches all tasks: it can't have more than (mean distinct terms of a document) / LOW terms, however
many documents there are. Comparing each document with its successor by id takes one shuffle that
sorts by id in ranges; only the first row of each range is looked up for the range before it.

Defined results: null and empty texts are alike; texts without lexicon terms get hashes of the
whole text, so they are like equal texts only; very long texts count whole; equal ids are ordered
by text; null ids come last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, importable, text_of
from ._pretoken import joined
from ._text import ALNUM, U, blocks, mix64, seeds, utf8, word_hashes

#: The band: shares of documents that hold a term.
LOW, HIGH = 1 / 1000, 0.3
SUBSETS = 40
LEVELS = 8


def term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): documents that hold the term whose 64-bit hash is term."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, pending = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merge():
            nonlocal terms, counts, pending
            each, back = np.unique(np.concatenate([terms, *pending]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(len(back) - len(counts), np.int64)])
            terms, counts, pending = each, np.bincount(back, weight, len(each)).astype(np.int64), []

        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in blocks(at):
                words, first = word_hashes(data, at[i : j + 1], ALNUM)
                words = words.view(np.int64)
                pending += [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                if sum(map(len, pending)) > 1_000_000:
                    merge()
                if len(terms) > 1_000_000:  # bounded memory; parts are summed later
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])
                    terms, counts = terms[:0], counts[:0]
        merge()
        for i in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=["term", "n"])

    return df.select(f"`{text}`").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = df.count()
    rows = term_counts(df, text).where((F.col("n") >= max(2, low * n)) & (F.col("n") <= high * n)).select("term")
    return np.sort(np.array([r.term for r in rows.collect()], np.int64).view(U))


class Fingerprinter:
    """Hashes of texts by a lexicon."""

    def __init__(self, terms: np.ndarray, subsets: int = SUBSETS, levels: int = LEVELS):
        self.terms = terms
        self.filter = np.zeros(1 << 22, bool)  # most words outside the lexicon stop here
        self.filter[(terms & U((1 << 22) - 1)).astype(np.int64)] = True
        self.values = np.zeros((subsets, len(terms)), U)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(seeds(subsets, 23)):
                mixed = mix64(terms ^ seed)
                chosen = (mixed >> U(40)) < U((1 << 24) >> (1 + k * levels // subsets))
                self.values[k] = np.where(chosen, mix64(mixed) | U(1), U(0))

    def hashes(self, texts: list[str]) -> np.ndarray:
        """32-bit hashes, a row for each text and a column for each subset; 0 where it has no term."""
        data, at = joined(texts)
        words, first = word_hashes(data, at, ALNUM)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        keep = self.filter[(words & U((1 << 22) - 1)).astype(np.int64)]
        words, doc = words[keep], doc[keep]
        if len(self.terms):
            i = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
            hit = self.terms[i] == words
        else:
            i, hit = np.zeros(0, np.int64), np.zeros(0, bool)
        own = np.unique(doc[hit] * (1 << 32) + i[hit])  # each document's distinct terms, sorted
        doc, term = own >> 32, own & ((1 << 32) - 1)
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = np.zeros((len(texts), len(self.values)), U)
        with np.errstate(over="ignore"):
            for k, values in enumerate(self.values):
                sums = np.concatenate((np.zeros(1, U), np.cumsum(values[term], dtype=U)))
                out[:, k] = mix64(sums[edge[1:]] - sums[edge[:-1]]) >> U(32)
        for r in np.flatnonzero(edge[1:] == edge[:-1]).tolist():  # no term: the whole text
            whole = hashlib.sha256(texts[r].encode("utf-8", "surrogatepass")).digest()
            out[r] = mix64(np.frombuffer(whole[:8], U) ^ np.arange(1, len(self.values) + 1, dtype=U)) >> U(32)
        return out


def likeness(a: np.ndarray, b: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Weighted share of equal hashes among those that either has, row by row."""
    weight = 2.0 ** (1 + np.arange(a.shape[1]) * levels // a.shape[1])
    either = ((a != 0) | (b != 0)) @ weight
    same = ((a == b) & (a != 0)) @ weight
    return np.where(either > 0, same / np.maximum(either, 1), (a == b).all(axis=1) * 1.0)


def shown(hashes: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in hashes.astype(">u4")]


def fingerprints(df: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for each row of df."""
    importable(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(terms)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at):
                texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shown(maker.hashes(texts)), pa.string())], names=["key", "fingerprint"])

    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"key {kind}, fingerprint string")


def in_order(df: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """df as (key, text, guest), by falling key in each partition; a guest row, at the end, is the
    first row of the next range. Partitions hold whole ranges of keys."""
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("key"), text_of(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{key}`").cast("double"), F.lit(float("-inf"))).alias("place"))
    ends = df.select(F.percentile_approx(F.col(f"`{key}`").cast("double"), [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    splits = [float("-inf"), *sorted(set(ends)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(rows) if len(splits) > 2 else rows.withColumn("range", F.lit(0.0))
    # the first row of a range has its largest key; one row for each range reaches the driver
    heads = sorted(((int(r["range"]), r.top) for r in ranged.groupBy("range").agg(F.max("key").alias("top")).collect()), reverse=True)
    # a number for each range that repartition() sends to a partition of its own
    n = len(splits)
    spread = {}
    for r in spark.range(40 * n).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("to")).collect():
        spread.setdefault(r.to, r.id)
    number = F.create_map(*[F.lit(x) for i in range(len(splits)) for x in (i, spread.get(i, i))])
    before = {heads[(i + 1) % len(heads)][0]: r for i, (r, _) in enumerate(heads)}  # the range whose last row precedes this one's first
    own = ranged.select("key", "text", F.col("range").cast("int").alias("range"), F.lit(False).alias("guest"))
    if not heads:
        return own.select("key", "text", "guest")
    tops = [top for _, top in heads if top is not None]
    first = F.col("key").isin(tops) if tops else F.lit(False)
    if any(top is None for _, top in heads):  # a range of null keys alone
        first = first | F.col("key").isNull()
    guests = own.where(first).select("key", "text", F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("range")].alias("range"), F.lit(True).alias("guest"))
    # of many rows with the same first key only the least text is wanted, and of null keys, too
    guests = guests.groupBy("range", "guest").agg(F.min(F.struct("text", "key")).alias("r")).select("r.key", "r.text", "range", "guest")
    return own.unionByName(guests).repartition(n, number[F.col("range")]).sortWithinPartitions("range", "guest", F.desc_nulls_last("key"), "text").select("key", "text", "range", "guest")


def compare_with_next(df: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness, also to the next row.

    The edited text has the last third of the code points replaced by as many of the next row's
    first; the row after the last is the first.
    """
    importable(df.sparkSession)
    kind = dict(df.dtypes)[key]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(terms)
        held: tuple | None = None  # a row that waits for the next one

        def out(rows: list[tuple], after: str) -> pa.RecordBatch:
            texts = [r[1] for r in rows]
            nexts = [*texts[1:], after]
            edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
            own, new = maker.hashes([*texts, after]), maker.hashes(edited)
            sums = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
            cols = [pa.array([r[0] for r in rows], key_arrow), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums), pa.array(shown(own[:-1])), pa.array(shown(new)), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            key_arrow = batch.column(0).type
            keys, guests, ranges = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            data, at = utf8(batch.column(1))
            for i, j in blocks(at, 1 << 20):
                rows = [held] if held else []
                held = None
                for r in range(i, j):
                    t = data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace")
                    if guests[r] or (rows and rows[-1][2] != ranges[r]):
                        if rows:
                            yield out(rows, t)
                        rows = []
                    if not guests[r]:
                        rows.append((keys[r], t, ranges[r]))
                if len(rows) > 1:
                    yield out(rows[:-1], rows[-1][1])
                held = rows[-1] if rows else None

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(df, key, text, parts).mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = documents(spark, sf_dir)
    return compare_with_next(docs, lexicon(docs)).withColumnRenamed("key", "doc_id")

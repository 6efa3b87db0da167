r"""Substring dedup: seed and extend over words.

Every word covered by a run of ``WIDTH`` words that also starts anywhere else goes. Words are
``[^\x20\x09-\x0D]+``, unchanged; runs don't cross documents.

*Seeds.* Documents are winnowed: of each run of WIDTH words the least hash of ``GRAM`` words
(leftmost of equal ones) is its anchor. Equal runs have equal anchors at equal places, so only
documents that share an anchor can share a run. Neighbouring runs with one anchor form an entry.
The entries are joined on the anchors; an anchor that occurs once ends here, with almost all text.
Entries alike in all their words are one entry with a count, so that copies aren't looked at again.

*Extension.* An anchor may have WIDTH - GRAM + 1 places in a run. Matches are extended both ways by
halving these places: all runs of the half [a, b] share a words to the left of the anchor and
WIDTH - GRAM - b to its right, so the seed grows by these words, and entries are joined on the grown
seeds. A half that no other entry shares is dropped; one that is shared is halved again, until the
seed is a whole run. Matches are extended as groups, never as pairs: a passage in a thousand
documents costs a thousand rows a step, and no group meets in one task.

*Maximal repeats.* Runs that matched are united to the longest ranges of words of a document; a
range has WIDTH words at least.

Cost: a narrow row for each anchor (one in about 12 words) is shuffled by anchor; entries whose
anchor has other entries are read again from their texts (a join by document), as are the ranges at
the end. Counts are partial sums and what they are joined with are tables of their own, so that
adaptive execution can split a hot anchor.

Defined results: null and empty texts have no words; texts under WIDTH words stay whole; repeated
rows repeat all their runs; equal and null keys work like others; very long texts are parsed in
slices that overlap by WIDTH - 1 words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, importable, materialise, release, text_of
from ._text import NOT_WHITE, U, blocks, utf8
from ._words import prefix_sums, range_hashes, spans

WIDTH, GRAM = 35, 12
#: Words that are parsed at a time; places in them take the low PLACE bits of the anchors' order.
SLICE, PLACE = 1 << 20, 22


def entries(words: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block of rows: row, first start, last start and anchor (places in the row), the anchor's
    hash and that of all words, for each row's runs of width words with one anchor."""
    n, reach = len(words), width - gram + 1
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    sums = prefix_sums(words)
    at = np.arange(n - gram + 1)
    grams = range_hashes(sums, at, at + gram)
    bits = U((1 << PLACE) - 1)
    key = (grams & ~bits) | at.astype(U)
    grid = np.concatenate((key, np.full(-len(key) % reach, ~U(0)))).reshape(-1, reach)
    fore = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - width + 1
    anchor = (np.minimum(back[:starts], fore[reach - 1 : reach - 1 + starts]) & bits).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:starts]
    whole = first[1:][row] - np.arange(starts) >= width
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(cut[1:], starts) - 1
    cut, last = cut[whole[cut]], last[whole[cut]]
    t, base = anchor[cut], first[:-1][row[cut]]
    return row[cut], cut - base, last - base, t - base, grams[t], range_hashes(sums, cut, last + width, t - cut)


def slices(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words before it, words, first words of rows) of slices in which each run of width words is whole."""
    if len(words) <= SLICE:
        yield 0, words, first
    else:  # a block of one row
        for begin in range(0, len(words) - width + 1, SLICE):
            part = words[begin : begin + SLICE + width - 1]
            yield begin, part, np.array([0, len(part)])


def _parsed(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(u, v, at, last, seed, trig, entry) of all entries of docs (u, v, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, j in blocks(at):
                _, _, _, hashes, first = spans(data, at[i : j + 1], NOT_WHITE, lower=False)
                for before, words, heads in slices(hashes, first, width):
                    row, *places, trig, entry = entries(words, heads, width, gram)
                    take = pa.array(row + i, pa.int64())
                    cols = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array((p + before).astype(np.int32)) for p in places), pa.array(trig.view(np.int64)), pa.array(entry.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["u", "v", "at", "last", "seed", "trig", "entry"])

    return docs.mapInArrow(run, "u bigint, v bigint, at int, last int, seed int, trig bigint, entry bigint")


def halvings(places: int) -> list[list[tuple[int, int]]]:
    """Ranges (first, last) of an anchor's places by step: halves of halves, and single places at the
    end. All ranges of a step have one length; the last ones may lie beyond the places."""
    whole = 3
    while whole < places:
        whole *= 2
    out, size = [], whole
    while size > 3:
        size //= 2
        out.append([(a, a + size - 1) for a in range(0, whole, size)])
    out.append([(a, a) for a in range(whole)])
    return out


def grown(sums: np.ndarray, seed: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, gram: int) -> list[np.ndarray]:
    """By step an array (entries, ranges) of hashes of the grown seeds, and a mask of those that the
    entry has: some place of the range is one of its places low to high."""
    room, out = width - gram, []
    for ranges in halvings(room + 1):
        a, b = (np.array(x)[None, :] for x in zip(*ranges, strict=True))
        has = (a <= high[:, None]) & (b >= low[:, None])
        begin = np.where(has, seed[:, None] - a, 0)
        end = np.where(has, seed[:, None] + gram + np.maximum(room - b, 0), 0)
        out.append(np.ma.array(range_hashes(sums, begin, end, np.broadcast_to(a + 1, begin.shape)).view(np.int64), mask=~has))
    return out


def _contexts(docs: DataFrame, wanted: DataFrame, width: int, gram: int) -> DataFrame:
    """(u, v, seed, one, keys): the entries' grown seeds by step. one: the entry occurs once.

    Rows that are alike bring an entry twice, but no entry of theirs occurs once.
    """
    lists = wanted.groupBy("u", "v").agg(F.collect_list(F.struct("at", "last", "seed", "one")).alias("list"))
    both = docs.join(lists.hint("merge"), ["u", "v"]).select("u", "v", "text", "list")
    steps = len(halvings(width - gram + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for r in range(batch.num_rows):
                _, _, _, words, _ = spans(data, offsets[r : r + 2], NOT_WHITE, lower=False)
                flat = batch.column(3).slice(r, 1).flatten()
                at, last, seed = (np.asarray(flat.field(k)).astype(np.int64) for k in ("at", "last", "seed"))
                n = len(at)
                keys = []
                for k in grown(prefix_sums(words), seed, seed - last, seed - at, width, gram):
                    inner = pa.array(k.data.reshape(-1), mask=np.ma.getmaskarray(k).reshape(-1))
                    keys.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k.shape[1]), inner))
                take = pa.array(np.full(n, r))
                cols = [batch.column(0).take(take), batch.column(1).take(take), flat.field("seed"), flat.field("one"), *keys]
                yield pa.RecordBatch.from_arrays(cols, names=["u", "v", "seed", "one", *(f"k{i}" for i in range(steps))])

    made = both.mapInArrow(run, "u bigint, v bigint, seed int, one boolean, " + ", ".join(f"k{i} array<bigint>" for i in range(steps)))
    return made.select("u", "v", "seed", "one", F.array(*(f"k{i}" for i in range(steps))).alias("keys"))


def part_of(part, parts: int):
    """A function that takes this part of an array of so many parts."""
    size = lambda x: (F.size(x) / parts).cast("int")
    return lambda x: F.slice(x, part * size(x) + 1, size(x))


def _extended(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """(u, v, s): starts of the runs, of entries that occur once, that another entry has, too."""
    rows = contexts.withColumn("place", F.lit(0))
    levels = halvings(width - gram + 1)
    for step, ranges in enumerate(levels):
        size = ranges[0][1] - ranges[0][0] + 1
        # one range of the step before is cut in so many parts; rest: the parts' own keys
        parts = len(ranges) // (len(levels[step - 1]) if step else 1)
        cut = rows.select("u", "v", "seed", "one", "place", "keys", F.posexplode(F.element_at("keys", 1)).alias("part", "key")).where("key IS NOT NULL")
        rest = F.transform(F.slice("keys", 2, len(levels)), part_of(F.col("part"), parts))
        cut = materialise(cut.select("u", "v", "seed", "one", (F.col("place") + F.col("part") * size).alias("place"), "key", rest.alias("keys")), "cut")
        shared = materialise(cut.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("one").alias("some")).where("n > 1 AND some").select("key"), "shared")
        old, rows = rows, materialise(cut.join(shared, "key", "left_semi").drop("key"), "rows")
        for x in (cut, shared, *([old] if step else [])):
            release(x)
    return rows.where("one").select("u", "v", (F.col("seed") - F.col("place")).alias("s"))


def _keyed(key: str, text: str) -> list:
    """Two hashes that tell rows apart by key and text, and the text."""
    body = text_of(f"`{text}`")
    return [F.xxhash64(F.col(f"`{key}`"), body).alias("u"), F.xxhash64(F.lit(13), F.col(f"`{key}`"), body).alias("v"), body.alias("text")]


def repeats(df: DataFrame, key: str, text: str, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(u, v, list of (s, e)): ranges of words that repeated runs cover, not united yet, of rows that have any."""
    importable(df.sparkSession)
    docs = df.select(*_keyed(key, text))
    parsed = materialise(_parsed(docs, width, gram), "seeds")
    twice = materialise(parsed.groupBy("trig").count().where("count > 1").select("trig"), "anchors")
    near = materialise(parsed.join(twice.hint("merge"), "trig", "left_semi"), "joined")
    release(parsed)
    release(twice)
    kinds = materialise(near.groupBy("trig", "entry").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u", "v", "at", "last", "seed")).alias("at")), "entries")
    copies = materialise(kinds.where("n > 1").select("trig", "entry"), "copies")
    again = materialise(near.join(copies, ["trig", "entry"], "left_semi").select("u", "v", F.col("at").alias("s"), (F.col("last") + F.lit(width)).alias("e")), "again")
    release(near)
    release(copies)
    # anchors with several entries, one of which at least occurs once
    several = materialise(kinds.groupBy("trig").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("trig"), "several")
    wanted = kinds.join(several, "trig", "left_semi").select("at.*", (F.col("n") == 1).alias("one"))
    contexts = materialise(_contexts(docs, wanted, width, gram), "contexts")
    release(kinds)
    release(several)
    runs = materialise(_extended(contexts, width, gram), "runs")
    release(contexts)
    made = again.unionByName(runs.select("u", "v", "s", (F.col("s") + F.lit(width)).alias("e")))
    out = materialise(made.groupBy("u", "v").agg(F.collect_list(F.struct("s", "e")).alias("list")), "ranges")
    release(again)
    release(runs)
    return out


def united(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Of n words, whether some range covers the word."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:n]) > 0


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """A row per row of df: key, n_words, n_removed, ranges (first word, word after the last; the
    maximal repeats) and kept (the remaining words, joined by blanks) or, with digest, kept_sha256."""
    found = repeats(df, key, text, width, gram)
    rows = df.select(F.col(f"`{key}`").alias("key"), *_keyed(key, text))
    both = rows.join(found.hint("merge"), ["u", "v"], "left").select("key", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at):
                buf, begin, end, _, first = spans(data, at[i : j + 1], NOT_WHITE, lower=False)
                raw = buf.tobytes()
                sizes, gone, ranges, kept = [], [], [], []
                for r in range(i, j):
                    a, b = int(first[r - i]), int(first[r - i + 1])
                    cover = np.zeros(b - a, bool)
                    if batch.column(2)[r].is_valid:
                        flat = batch.column(2).slice(r, 1).flatten()
                        cover = united(np.asarray(flat.field("s")), np.asarray(flat.field("e")), b - a)
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False]))))
                    sizes.append(b - a)
                    gone.append(int(cover.sum()))
                    ranges.append([{"s": s, "e": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    stay = np.flatnonzero(~cover) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)]))
                last = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), last], names=names)

    names = ["key", "n_words", "n_removed", "ranges", "kept_sha256" if digest else "kept"]
    schema = f"key {dict(df.dtypes)[key]}, n_words bigint, n_removed bigint, ranges array<struct<s:int,e:int>>, {names[-1]} string"
    return both.mapInArrow(run, schema)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 35 words found more than once, over all documents."""
    out = drop_repeats(documents(spark, sf_dir), digest=True)
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: Every run as a string, counted over the table; for tables of small size.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words FROM d),
r AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(n_words - 33, 1))) AS s FROM n WHERE n_words >= 35)),
c AS (SELECT doc_id, s FROM r JOIN (SELECT h FROM r GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM c),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM n)
SELECT n.doc_id, n.n_words, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id LEFT JOIN g ON g.doc_id = k.doc_id AND g.i = k.i
GROUP BY n.doc_id, n.n_words
"""

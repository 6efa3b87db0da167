r"""Source divergence audit: how sources of a language differ in their use of terms.

Terms are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. A language keeps the V terms found
in at least ``LEAST_DOCS`` of its documents. A source with count c of a term and N of all kept terms
gives it p = 1 + floor(UNIT * (c + 5) / (N + 5 * V)); the whole language gives it q in the same way.

*Counts.* A scan counts terms of blocks of documents by (lang, source, term) in numpy; Spark sums
the blocks' counts, so that a source with any share of the rows is summed in parts first.

*Term blocks.* A language's kept terms are dealt into blocks by a hash of the term. A block comes
together as one dense int64 matrix, sources by terms, of ``CELLS`` cells about. All pairs of its
sources are computed by broadcasting slices of rows against all rows; each block gives a
partial matrix of pair sums and, for each source, a heap of its ``RANKS`` best terms.

*Sums.* Partial pair sums are added, and heaps merged, by (lang, source).

All arithmetic is on integers; the product with UNIT is divided in three steps of 1000, so that
counts may reach 9e15. The output has a row for each ordered pair of sources of a language, which is
asked for; nothing else grows with pairs, and no document is ever paired with another.

Defined results: null text, lang and source count as empty; a source without terms still has its pairs;
without kept terms all pairs are 0 and there are no terms; repeated rows count as documents of their
own; very long texts are counted whole; ties go by the UTF-8 bytes of the item; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, importable, materialise, release, text_of
from ._text import blocks, utf8
from ._words import LETTERS, spans

LEAST_DOCS, ADDED, UNIT, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of text whose terms are counted at a time.
COUNTED = 1 << 22
#: Cells of a dense matrix, about, if a source has fewer than CELLS / LEAST_TERMS fellows; up to MOST_CELLS
#: so that a block has LEAST_TERMS terms.
CELLS, LEAST_TERMS, MOST_CELLS = 1 << 16, 1 << 10, 1 << 23
#: Elements of a broadcast slice.
SLICE = 1 << 20


def counted(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """group, occurrences, documents, term: of each term of each group of a block of rows. group: of each row."""
    buf, begin, end, hashes, first = spans(data, offsets, LETTERS, lower=True)
    each, one, code = np.unique(hashes, return_index=True, return_inverse=True)
    width = max(len(each), 1)
    in_doc, times = np.unique(np.repeat(np.arange(len(group)), np.diff(first)) * width + code, return_counts=True)
    pair, back = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
    n, docs = np.zeros(len(pair), np.int64), np.bincount(back, minlength=len(pair))
    np.add.at(n, back, times)
    raw = buf.tobytes()
    terms = pa.array([raw[b:e] for b, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)], pa.binary())
    return pair // width, n, docs, terms.take(pa.array(pair % width)).cast(pa.string())


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; a row with the
    term '' for each (lang, source)."""
    importable(df.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            data, at = utf8(batch.column(2))
            for i, j in blocks(at, COUNTED):
                known: dict[tuple[str, str], int] = {}
                group = np.array([known.setdefault(p, len(known)) for p in pairs[i:j]])
                g, n, docs, term = counted(group, data, at[i : j + 1])
                who = list(known)
                zero = np.zeros(len(who), np.int64)
                g = pa.array(np.concatenate((g, np.arange(len(who)))))
                term = pa.concat_arrays([term, pa.array([""] * len(who), pa.string())])
                cols = [*(pa.array([w[k] for w in who], pa.string()).take(g) for k in (0, 1)), term, *(pa.array(np.concatenate((x, zero))) for x in (n, docs))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = df.select(text_of(f"`{lang}`").alias("lang"), text_of(f"`{source}`").alias("source"), text_of(f"`{text}`").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) of whole numbers with count <= total < 9e15, by long division."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + q
    return out + 1


def pair_sums(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sums): of each row i of p and the rows behind it, the sums of absolute differences."""
    g, terms = p.shape
    step = max(1, SLICE // max(1, g * terms))
    for a in range(0, g, step):
        part = np.abs(p[a : a + step, None, :] - p[None, a:, :]).sum(axis=2)
        for i in range(len(part)):
            yield a + i, part[i, i + 1 :]


def best(values: np.ndarray, ranks: int) -> np.ndarray:
    """Places of the ranks largest positive values, largest first, leftmost of equal ones first."""
    at = np.flatnonzero(values > 0)
    if len(at) > ranks:
        at = at[values[at] >= np.partition(values[at], -ranks)[-ranks]]
    return at[np.argsort(-values[at], kind="stable")][:ranks]


def tile(rows: pa.Table) -> pa.Table:
    """(lang, source, part, item, value) of one block of terms: partial sums of pairs of sources
    (each pair once), and each source's best terms. rows (lang, block, source, term, n, kept): a row without
    term for each source, with the sum of its counts and the number of kept terms."""
    head = rows.filter(pc.is_null(rows["term"])).sort_by("source")
    body = rows.filter(pc.is_valid(rows["term"]))
    who = head["source"].combine_chunks()
    terms = pc.unique(body["term"])
    terms = terms.take(pc.sort_indices(terms))
    count = np.zeros((len(who), len(terms)), np.int64)
    count[np.asarray(pc.index_in(body["source"], who)), np.asarray(pc.index_in(body["term"], terms))] = np.asarray(body["n"])
    total, kept = np.asarray(head["n"]), int(head["kept"][0].as_py())
    p = shares(count + ADDED, (total + ADDED * kept)[:, None])
    q = shares(count.sum(axis=0) + ADDED, total.sum() + ADDED * kept)
    first, second, value = [], [], []
    for i, sums in pair_sums(p):
        first.append(np.full(len(sums), i))
        second.append(np.arange(i + 1, len(who)))
        value.append(sums)
    top = [best(np.where(count[i] > 0, p[i] - q, 0), RANKS) for i in range(len(who))]
    owner = np.repeat(np.arange(len(who)), [len(t) for t in top])
    top = np.concatenate([*top, np.zeros(0, np.int64)])
    first, second, value = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (first, second, value))
    n = len(first), len(top)
    return pa.table({
        "lang": pa.array([rows["lang"][0].as_py()] * sum(n), pa.string()),
        "source": who.take(pa.array(np.concatenate((first, owner)))),
        "part": pa.array(["pair"] * n[0] + ["term"] * n[1], pa.string()),
        "item": pa.concat_arrays([who.take(pa.array(second)), (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).take(pa.array(top))]),
        "value": pa.array(np.concatenate((value, (p - q)[owner, top]))),
    })


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: distances to the other sources of the
    language; part term: the RANKS terms that the source uses most beyond the language."""
    counts = materialise(term_counts(df, lang, source, text), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    kept = materialise(kept, "kept")
    groups = counts.where("term = ''").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").fillna(0, ["kept"])
    tile_cells = F.greatest(F.lit(cells), F.least(F.col("sources") * LEAST_TERMS, F.lit(max(cells, MOST_CELLS))))
    sizes = materialise(sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / tile_cells)).cast("int")), "sizes")
    rows = materialise(counts.where("n > 0").join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "rows")
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    heads = groups.join(sums, ["lang", "source"], "left").fillna(0, ["n"]).join(sizes, "lang")
    heads = heads.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "kept")
    body = rows.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", "kept")
    found = heads.unionByName(body).groupBy("lang", "block").applyInArrow(tile, "lang string, source string, part string, item string, value bigint")
    found = materialise(found, "tiles")
    for x in (counts, kept, rows, sizes):
        release(x)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best_pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    heaps = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    return best_pairs.unionByName(heaps.select("lang", "source", "part", "item", "value", "rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources, and each source's terms, over all documents."""
    return audit(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
cnt AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
tot AS (SELECT grp.lang, grp.source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source GROUP BY 1, 2),
p AS (SELECT tot.lang, tot.source, kept.term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v.v) AS BIGINT) AS p
      FROM tot JOIN v ON v.lang = tot.lang JOIN kept ON kept.lang = tot.lang LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.term = kept.term),
ql AS (SELECT lang, term, sum(c) AS c FROM p GROUP BY 1, 2),
qn AS (SELECT lang, sum(n) AS n FROM tot GROUP BY 1),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v.v) AS BIGINT) AS q FROM ql JOIN qn USING (lang) JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
       ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tr AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM tr)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= 50
"""

r"""Suffix-array dedup by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Texts are
UTF-8 bytes; strings don't cross documents.

*Triggers.* The rolling hash of ``GRAM`` bytes that is least (leftmost of equal ones) in a string of
LENGTH bytes is its trigger. It depends on the string alone, so equal strings have equal triggers
at equal places, and runs of strings with one trigger cut each document into phrases.

*Dictionary and parse.* A phrase comes with the bytes after it that its last string needs (its
context). Documents are parsed into phrases; equal phrases are one entry of the dictionary, with a
count. Strings of a phrase whose trigger occurs once are unique: almost all text ends here. All
strings of a phrase that occurs twice are repeated: no further look at copies.

*Corpus order.* Entries that share a trigger are brought together, and the suffixes that start in
their phrases are sorted by their first LENGTH bytes: ranks of 8 bytes are doubled to 64, and ties
are sorted on by the ranks behind. An entry stands for all its places, so these ranks give the order of all suffixes of
the corpus that can be repeated; equal ranks are repeated strings. Suffixes of other triggers can't
be equal and needn't be compared.

Cost: narrow rows for phrases (one in about 137 bytes) are shuffled twice, those whose trigger occurs
once end after the first; texts move twice, to be met by the places of their entries and by their
ranges to remove. These joins are merge joins at every size.
A task of the sort holds about a MB: a trigger with more than ``GROUP`` entries isn't sorted in one
task, the hashes of its strings are counted instead, spread over all tasks, with the same outcome.
Texts over ``BLOCK`` bytes are parsed in slices that overlap by LENGTH - 1 bytes.

Defined results: null and empty texts have 0 bytes; texts under LENGTH bytes stay whole; repeated
rows repeat all their strings; equal and null keys work like others; an empty table gives no rows;
other columns are ignored by :func:`repeats` and pass through :func:`drop_repeats`. A cut inside a
character leaves bytes; where text is wanted, ranges are narrowed to whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, few_rows, importable, materialise, release
from ._text import BYTE_CODE, U, blocks, mix64, powers, utf8

LENGTH = 400
#: A trigger's bytes: 128 of 400.
GRAM_SHARE = 0.32
#: Entries of one trigger that one task sorts at most, and bytes that it sorts at a time, about.
GROUP, SORTED = 2000, 1 << 20
#: Bytes that are parsed at a time; places in them take the low PLACE bits of the triggers' order.
BLOCK, PLACE = 1 << 20, 22


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block of rows: row, first start, last start (in the row), trigger's hash, hash of the
    phrase with its context, for each run of strings with one trigger. At most 1 << PLACE bytes."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    if n < length:
        return none
    up, down = powers(n + 1)
    width = length - gram + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_CODE[data] * up[:n], out=sums[1:])
        grams = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = U((1 << PLACE) - 1)
    key = (grams & ~bits) | np.arange(len(grams), dtype=U)
    pad = -len(key) % width
    grid = np.concatenate((key, np.full(pad, ~U(0)))).reshape(-1, width)
    fore = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = len(key) - width + 1
    least = (np.minimum(back[:starts], fore[width - 1 : width - 1 + starts]) & bits).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[:starts]
    valid = (offsets[1:] - offsets[0])[row] - np.arange(starts) >= length
    cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (row[1:] != row[:-1]))))
    end = np.append(cut[1:], starts) - 1
    keep = valid[cut]
    cut, end = cut[keep], end[keep]
    trigger = least[cut]
    with np.errstate(over="ignore"):
        whole = mix64((sums[end + length] - sums[cut]) * down[cut])
        entry = mix64(whole + mix64((end - cut + 1).astype(U)) * U(31) + mix64((trigger - cut + 1).astype(U)))
    base = (offsets[:-1] - offsets[0])[row[cut]]
    return row[cut], cut - base, end - base, grams[trigger], entry


def ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of all places of data by the next length bytes (bytes beyond the end count as 0)."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    size, total = 8, n + length
    eight = np.zeros(total, U)
    with np.errstate(over="ignore"):
        for i in range(8):
            eight = (eight << U(8)) | padded[i : i + total].astype(U)
    rank = np.unique(eight, return_inverse=True)[1].astype(U)
    while size < length:
        step = min(size, length - size)
        rank = np.unique((rank[: len(rank) - step] << U(32)) | rank[step:], return_inverse=True)[1].astype(U)
        size += step
    return rank[:n].astype(np.int64)


def repeated(data: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the string of length bytes at each place is at another place, too.

    Suffixes are ranked by 64 bytes by doubling; only ties are compared further, by the ranks behind.
    """
    done = width = min(64, length)
    rank = ranks(data, width)
    alive, own = np.arange(len(place)), rank[place]
    while True:
        _, own, count = np.unique(own, return_inverse=True, return_counts=True)
        tie = count[own] > 1
        alive, own = alive[tie], own[tie].astype(U)
        if done >= length or not len(alive):
            break
        step = min(done, length - width)
        own = (own << U(32)) | rank[place[alive] + step].astype(U)
        done = step + width
    out = np.zeros(len(place), bool)
    out[alive] = True
    return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ranges of bytes that strings at the sorted starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist(), strict=True))


def pieces(at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of whole rows: first row, 0, cuts of the rows; and slices of longer rows: row, begin in
    the row, cuts. Each string of length bytes is whole in one piece."""
    for i, j in blocks(at, BLOCK):
        size = int(at[j] - at[i])
        if size <= BLOCK:
            yield i, 0, at[i : j + 1] - at[i]
        else:  # a single row
            for begin in range(0, size - length + 1, BLOCK):
                yield i, begin, np.array([0, min(BLOCK + length - 1, size - begin)])


def _parsed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(u, v, at, last, trig, entry) of all phrases of docs (u, v, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, begin, cuts in pieces(at, length):
                row, first, last, trig, entry = phrases(data[at[i] + begin : at[i] + begin + cuts[-1]], cuts, length, gram)
                first, last = first + begin, last + begin
                take = pa.array(row + i, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(trig.view(np.int64)), pa.array(entry.view(np.int64))], names=["u", "v", "at", "last", "trig", "entry"])

    return docs.mapInArrow(run, "u bigint, v bigint, at int, last int, trig bigint, entry bigint")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(trig, u, v, at, size, one, raw, kinds): the entries' bytes. size: strings; one: it occurs once.

    Rows that are alike bring an entry twice, but no entry of theirs occurs once.
    """
    lists = wanted.groupBy("u", "v").agg(F.collect_list(F.struct("trig", "at", "last", "one", "kinds")).alias("list"))
    both = docs.join(lists.hint("merge"), ["u", "v"]).select("u", "v", F.col("text").cast("binary").alias("raw"), F.explode("list").alias("e"))
    cut = F.substring("raw", F.col("e.at") + 1, F.col("e.last") - F.col("e.at") + length)
    return both.select("e.trig", "u", "v", "e.at", (F.col("e.last") - F.col("e.at") + 1).alias("size"), "e.one", cut.alias("raw"), "e.kinds")


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    """(u, v, s, e): ranges that repeated strings cover, of entries that occur once. Entries of a
    trigger stand together in a partition; groups are sorted some MB at a time."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        raw = [r[4] for r in rows]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        sizes = np.array([r[3] for r in rows])
        place = np.repeat(cuts[:-1], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        twice = repeated(np.frombuffer(b"".join(raw), np.uint8), place, length)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        for k, (u, v, at, _, _, one) in enumerate(rows):
            if one:
                for s, e in covered(np.flatnonzero(twice[edge[k] : edge[k + 1]]), length):
                    yield u, v, at + s, at + e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None

        def out(rows):
            found = list(work(rows))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["u", "v", "s", "e"])

        for batch in batches:
            for trig, u, v, at, n, one, raw in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if size > SORTED and trig != last:
                    yield out(rows)
                    rows, size = [], 0
                rows.append((u, v, at, n, raw, one))
                size, last = size + len(raw), trig
        if rows:
            yield out(rows)

    grouped = contexts.drop("kinds").repartition("trig").sortWithinPartitions("trig")
    return grouped.mapInArrow(run, "u bigint, v bigint, s int, e int")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """As :func:`_sorted`, for triggers with very many entries: strings are counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, v, at, n, one, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
                data = np.frombuffer(raw, np.uint8)
                up, down = powers(len(data) + 1)
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(data) + 1, U)
                    np.cumsum(BYTE_CODE[data] * up[:-1], out=sums[1:])
                    h = mix64((sums[length : length + n] - sums[:n]) * down[:n])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.full(n, x, t)) for x, t in ((u, np.int64), (v, np.int64))), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(np.full(n, one))], names=["h", "u", "v", "s", "one"])

    strings = materialise(contexts.drop("kinds").mapInArrow(run, "h bigint, u bigint, v bigint, s int, one boolean"), "strings")
    twice = strings.groupBy("h").count().where("count > 1").select("h")
    return strings.where("one").join(twice, "h", "left_semi").select("u", "v", "s", (F.col("s") + F.lit(length)).alias("e"))


def _keyed(df: DataFrame, key: str, text: str):
    """Two hashes that tell rows apart by key and text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.xxhash64(F.col(f"`{key}`"), body).alias("u"), F.xxhash64(F.lit(7), F.col(f"`{key}`"), body).alias("v"), body.alias("text")]


def ranges(df: DataFrame, key: str, text: str, length: int = LENGTH, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """(u, v, list of (s, e)): the bytes to remove, of rows that have any."""
    importable(df.sparkSession)
    gram = gram or max(1, int(length * GRAM_SHARE))
    docs = df.select(*_keyed(df, key, text))
    parsed = materialise(_parsed(docs, length, gram), "parsed")
    # a table of its own: adaptive execution splits a hot trigger only between two plain exchanges
    twice = materialise(parsed.groupBy("trig").count().where("count > 1").select("trig"), "twice")
    near = materialise(parsed.join(twice.hint("merge"), "trig", "left_semi"), "near")
    release(parsed)
    release(twice)
    entries = near.groupBy("trig", "entry").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u", "v", "at", "last")).alias("at"))
    entries = materialise(entries, "entries")
    again = near.join(entries.where("n > 1").select("trig", "entry"), ["trig", "entry"], "left_semi").select("u", "v", F.col("at").alias("s"), (F.col("last") + F.lit(length)).alias("e"))
    again = materialise(again, "again")
    release(near)
    kinds = materialise(entries.groupBy("trig").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    wanted = entries.join(kinds, "trig").select("trig", "kinds", "at.u", "at.v", "at.at", "at.last", (F.col("n") == 1).alias("one"))
    contexts = materialise(_contexts(docs, wanted, length), "contexts")
    release(entries)
    release(kinds)
    few = materialise(_sorted(contexts.where(F.col("kinds") <= group), length), "few")
    made = [again, few]
    if not few_rows(contexts.where(F.col("kinds") > group), 0):
        made.append(materialise(_counted(contexts.where(F.col("kinds") > group), length), "many"))
    release(contexts)
    out = reduce(DataFrame.unionByName, made)
    out = materialise(out.groupBy("u", "v").agg(F.collect_list(F.struct("s", "e")).alias("list")), "ranges")
    for x in made:
        release(x)
    return out


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, group: int = GROUP, carry: tuple[str, ...] = (), whole_characters: bool = False, digest: bool = False) -> DataFrame:
    """A row per row of df: carried columns, key, n_bytes, n_removed, n_spans, spans (bytes), and kept
    (the remaining bytes) or, with digest, kept_sha256."""
    found = ranges(df, key, text, length, gram, group)
    names = [*carry] if key in carry else [key, *carry]
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), *_keyed(df, key, text))
    both = rows.join(found.hint("merge"), ["u", "v"], "left").select(*(f"c{i}" for i in range(len(names))), "text", "list")
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(width))
            for i, j in blocks(at):
                lists = batch.column(width + 1).slice(i, j - i).to_pylist()
                sizes, gone, spans, kept = [], [], [], []
                for r, pairs in zip(range(i, j), lists, strict=True):
                    raw = data[at[r] : at[r + 1]].tobytes()
                    cut = merged([(p["s"], p["e"]) for p in pairs or ()])
                    if whole_characters:
                        cut = [(s, e) for s, e in (_inside(raw, s, e) for s, e in cut) if s < e]
                    edge = [0, *(x for c in cut for x in c), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                    sizes.append(len(raw))
                    gone.append(sum(e - s for s, e in cut))
                    spans.append([{"s": s, "e": e} for s, e in cut])
                last = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(width)), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), last], names=out_names)

    kinds = dict(df.dtypes)
    out_names = [*(f"c{i}" for i in range(width)), "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256" if digest else "kept"]
    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names)) + ", n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<s:int,e:int>>, " + ("kept_sha256 string" if digest else "kept binary")
    made = both.mapInArrow(run, schema)
    return made.select(*(F.col(f"c{i}").alias(f"_gl_{c}" if c in out_names else c) for i, c in enumerate(names)), *out_names[width:])


def _inside(raw: bytes, s: int, e: int) -> tuple[int, int]:
    """The range s to e, narrowed to whole UTF-8 characters."""
    while s < e and raw[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """df with the repeated bytes taken out of its texts (whole characters); same columns.

    Rows stay, even with an empty text; null texts stay null.
    """
    others = [c for c in df.columns if c != text]
    safe = df.select(*(F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(others)), F.col(f"`{text}`").alias("body"))
    carry = tuple(f"d{i}" for i in range(len(others)))
    marked = safe.withColumn("absent", F.col("body").isNull())
    out = repeats(marked, f"d{others.index(key)}", "body", length, carry=(*carry, "absent"), whole_characters=True)
    body = F.when(~F.col("absent"), F.col("kept").cast("string")).alias(text)
    return out.select(*(body if c == text else F.col(f"d{others.index(c)}").alias(c) for c in df.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes found more than once, over all documents."""
    out = repeats(documents(spark, sf_dir), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

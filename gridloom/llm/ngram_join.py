r"""N-gram Jaccard join: grouped prefix join over word shingles.

Documents are sets of k-word shingles (64-bit hashes). Two sets of sizes n and m link when
100 * intersection >= percent * union. In any order of the shingles, sets that link share one of the
first n - ceil(percent * n / 100) + 1 of each (the prefix). This also holds for what they have in a
fixed part of all shingles, as long as that part gives each set a whole prefix. Sets are joined in
bands of sizes: smaller ones on all shingles, larger ones on those with hashes below a bound. A set
that may link with smaller ones of the band below is listed in that band, too. The steps:

1. Shingles are counted over all documents; rare ones come first in the order. Each list is joined
   with the counts of its shared shingles; a list whose prefix is full of shingles that it alone has
   meets nothing: almost all sets end here. The sets that are left are ordered once more, by all their
   shingles and counts among themselves: near copies whose edits lie outside of the part end here.
2. Sets with identical prefix and size form groups, each looked at through one leader: in a few
   rounds every set is verified against one leader that shares a prefix shingle, and joins its class.
   This needs a row for each set, however large a family of near copies is.
   A pair is looked at by histograms of its hashes first, which bound the intersection from above.
3. Groups (same prefix, size and class) meet at their shared prefix shingles; pairs of other classes
   whose sizes, and the shingle's places in both orders, leave room for enough common shingles are
   expanded into members, and each pair is verified by its full sets.

Links between sets of one class, which is connected already, are not looked for; nothing else is
left out, so components are exact. All decisions on links use whole sets; equal sets are one.

Defined results: null and empty texts and texts without words have no shingles, are linked with
nothing and form their own component; fewer than k words are one shingle; rows with a null key are
not linked and have a null component; a repeated key has the component of each row's own text, and
:func:`drop_near_copies` removes its rows by themselves; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import documents, few_rows, importable, materialise, release
from ._graph import components
from ._text import NOT_WHITE, U, blocks, mix64, seeds, shingles, utf8, word_hashes

#: Least sizes of the bands, and the prefixes that the part of a band of larger sets holds on average.
#: A part of few prefixes is short, but its prefixes reach into frequent shingles, where many sets meet.
BANDS, PREFIXES = (0, 320), 2.5
#: Classes of a set's hashes in its histogram.
CLASSES = 64
#: Rounds in which each set meets one leader.
ROUNDS = 3
#: Rows of (hash) that are sent to all tasks at most; more are joined by shuffling.
SENT = 200_000


def prefix_of(n, percent: int):
    """Prefix length of a set of n shingles (a column or number)."""
    return n - (n * percent + 99) // 100 + 1


def prefix_column(n, percent: int):
    return (n - F.floor((n * percent + 99) / 100) + 1).cast("int")


def share_of(least: int, percent: int) -> float:
    """The part of all shingles for sets of least shingles and more."""
    return min(1.0, PREFIXES * (1 - percent / 100)) if least else 1.0


def name_of(s: np.ndarray) -> tuple[U, U]:
    """sid and check of a set of hashes."""
    return mix64(np.sum(mix64(s), dtype=U, keepdims=True))[0], np.sum(mix64(s ^ U(0x5851F42D4C957F2D)), dtype=U)


def _lists(arrays):
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, U), *arrays]).view(np.int64)))


def sets_of(df: DataFrame, key: str, text: str, k: int, percent: int, parts: bool = True) -> DataFrame:
    """(key, n, sid, check, lists): shingle sets by two 64-bit sums. lists: (lid, size, hashes) of the
    set's band and, if it may link with sets of it, of the band below."""
    importable(df.sparkSession)
    kind = dict(df.dtypes)[key]
    shares = [share_of(x, percent) if parts else 1.0 for x in BANDS]
    bounds = [U(min((1 << 64) - 1, int(x * (1 << 64)))) for x in shares]
    flips = [seed for seed in seeds(len(BANDS), 17)]  # hashes of different bands never meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at, 1 << 20):
                words, first = word_hashes(data, at[i : j + 1], NOT_WHITE)
                sizes, ids, checks, cuts, lids, lists = [], [], [], [0], [], []
                with np.errstate(over="ignore"):
                    for s in shingles(words, first, k):
                        n = len(s)
                        sizes.append(n)
                        a, b = name_of(s)
                        ids.append(a)
                        checks.append(b)
                        band = bisect.bisect_right(BANDS, n) - 1
                        below = band > 0 and n * percent < BANDS[band] * 100
                        for x in (band, band - 1) if below else (band,) if n else ():
                            lids.append(a ^ flips[x])
                            lists.append(s[: np.searchsorted(s, bounds[x])] ^ flips[x] if shares[x] < 1 else s ^ flips[x])
                        cuts.append(len(lids))
                    lids = mix64(np.array(lids, U)).view(np.int64)
                inner = pa.StructArray.from_arrays([pa.array(lids), pa.array([len(x) for x in lists], pa.int64()), _lists(lists)], names=["lid", "size", "hashes"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(np.array(ids, U).view(np.int64)), pa.array(np.array(checks, U).view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), inner)], names=["key", "n", "sid", "check", "lists"])

    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"key {kind}, n bigint, sid bigint, check bigint, lists array<struct<lid:bigint,size:bigint,hashes:array<bigint>>>")


def sent(df: DataFrame) -> DataFrame:
    """df (materialised, narrow), marked to be sent to all tasks if it is small."""
    return F.broadcast(df) if few_rows(df, SENT) else df


def linked(common, n, m, percent: int):
    return common * (100 + percent) >= (n + m) * percent


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90, rounds: int = ROUNDS, parts: bool = True) -> DataFrame:
    """(key, n_shingles, component) for each row of df; component: the least key reachable."""
    return _placed(df, key, text, k, percent, rounds, parts).select("key", F.col("n").alias("n_shingles"), "component")


def _placed(df: DataFrame, key: str, text: str, k: int, percent: int, rounds: int = ROUNDS, parts: bool = True) -> DataFrame:
    """(key, n, sid, check, component) for each row of df. parts: let bands use parts of the shingles."""
    p = lambda: prefix_column(F.col("n"), percent)
    rows = materialise(sets_of(df, key, text, k, percent, parts), "rows")
    if parts and not few_rows(rows.where(F.exists("lists", lambda x: x["size"] < p())), 0):
        release(rows)
        return _placed(df, key, text, k, percent, rounds, False)  # a set without a whole prefix in a part: take all
    named = rows.where("n > 0 AND key IS NOT NULL")
    sets = materialise(named.groupBy("sid", "check", "n").agg(F.min("key").alias("least")), "sets")

    # 1. prefixes in the order of the shingles' counts, in the bands' lists
    lists = named.select("sid", "n", F.explode("lists").alias("l"))
    met = _met(lists.select("sid", "n", "l.lid", "l.size", "l.hashes"), percent)
    rows_named = materialise(rows.select("key", "n", "sid", "check"), "named")
    release(rows)
    rows = rows_named
    # the sets that meet, once more by their whole sets: a part of few shingles tells little of what a set has alone
    whole = _whole_sets(df, key, text, k, sets.join(met.select("sid").distinct(), "sid", "left_semi"))
    meet = _met(whole.select("sid", "n", F.col("sid").alias("lid"), F.col("n").alias("size"), "hashes"), percent)
    release(met)

    # 2. classes by leaders
    able = meet.groupBy("sid", "n").agg(F.count(F.lit(1)).alias("live"))
    classes = materialise(able.select("sid", "n", "live", F.col("sid").alias("cls")), "classes")
    for r in range(rounds):
        heads = classes.where("sid = cls").select("sid", "n", "live")
        at = meet.join(heads.select("sid", "live"), "sid").groupBy("sid", "n", "live").agg(F.min(F.struct(F.xxhash64("h", F.lit(r)).alias("o"), "h")).alias("k"))
        at = materialise(at.select("sid", "n", "live", "k.h", F.floor(F.log(F.col("n").cast("double")) / 0.1).alias("size")), "at")
        leaders = at.groupBy("h", "size").agg(F.max(F.struct("live", "sid")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
        # a table of its own: a family's rows needn't meet its one leader in one task
        leaders = materialise(leaders.select("h", "size", F.col("l.sid").alias("leader")), "leaders")
        pairs = at.join(sent(leaders), ["h", "size"]).where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b"))
        found = materialise(_verified(pairs, whole, percent), "found")
        moved = found.select(F.col("a").alias("cls"), F.col("b").alias("to"))
        new = materialise(classes.join(moved, "cls", "left").select("sid", "n", "live", F.coalesce("to", "cls").alias("cls")), "classes")
        for x in (at, leaders, classes):
            release(x)
        classes = new
        if r and few_rows(found, 0):
            break

    # 3. groups of one prefix, size and class; pairs of groups of other classes; their members
    member = meet.join(classes.select("sid", "cls"), "sid")
    group = member.groupBy("sid", "n", "cls").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("prefix"))
    group = materialise(group.select("sid", "n", "cls", F.xxhash64("n", "cls", "prefix").alias("gid")), "groups")
    keyed = member.join(group.select("sid", "gid"), "sid").select("h", "gid", "n", "cls", "pos", "prev").distinct()
    other = keyed.select("h", *(F.col(c).alias(f"{c}2") for c in ("gid", "n", "cls", "pos", "prev")))
    near = (F.col("gid") < F.col("gid2")) & (F.col("cls") != F.col("cls2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
    # least intersection of sets that link; what stands before their first common shingle is missing from the other
    least = F.ceil((F.col("n") + F.col("n2")) * percent / (100.0 + percent) - 1e-9)
    near = near & (F.col("pos") <= F.col("n") - least + 1) & (F.col("pos2") <= F.col("n2") - least + 1) & (F.col("pos") + F.col("pos2") - 2 <= F.col("n") + F.col("n2") - 2 * least)
    # sets that share the shingle before this one, too, have met there
    near = near & ~F.coalesce(F.col("prev") == F.col("prev2"), F.lit(False))
    pairs = keyed.join(other, "h").where(near).select("gid", "gid2").distinct()
    left, right = group.select("gid", F.col("sid").alias("a")), group.select(F.col("gid").alias("gid2"), F.col("sid").alias("b"))
    found = materialise(_verified(pairs.join(left, "gid").join(right, "gid2").select("a", "b"), whole, percent), "found")

    of = lambda side: classes.select(F.col("sid").alias(side), F.col("cls").alias(f"c{side}"))
    bridges = found.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    if not few_rows(found, 0):
        roots = components(bridges)
        classes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("sid", F.coalesce("root", "cls").alias("cls"))
    final = sets.select("sid", "check", "least").join(classes.select("sid", "cls"), "sid", "left").select("sid", "check", "least", F.coalesce("cls", "sid").alias("cls"))
    least = final.groupBy("cls").agg(F.min("least").alias("component"))
    by_set = materialise(final.join(least, "cls").select("sid", "check", "component"), "components")
    placed = rows.join(by_set, ["sid", "check"], "left")
    return placed.select("key", "n", "sid", "check", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """(h, sid, n, pos, prev): the prefix shingles in which lists (sid, n, lid, size, hashes) of two sets meet.
    pos is the place in the list's order, from 1, and prev the shared shingle before."""
    p = prefix_column(F.col("n"), percent)
    each = lists.select("lid", F.explode("hashes").alias("h"))
    count = materialise(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "count")
    some = each.join(count.hint("merge"), "h").dropDuplicates(["h", "lid"])  # repeated texts bring a list again
    own = some.groupBy("lid").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("own"))
    own = own.join(lists.select("lid", "sid", "n", "size").distinct(), "lid")
    # shingles of a set alone come first and meet nothing
    alone = (F.col("size") - F.size("own")).cast("int")
    meet = own.where(alone < p).select("sid", "n", alone.alias("alone"), F.col("own")["h"].alias("list"), F.posexplode(F.slice("own", 1, F.greatest(F.lit(0), p - alone))["h"]).alias("i", "h"))
    meet = materialise(meet.select("sid", "n", "h", (F.col("alone") + F.col("i") + 1).alias("pos"), F.get("list", F.col("i") - 1).alias("prev")), "meet")
    both = materialise(meet.groupBy("h").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("h"), "both")
    met = materialise(meet.join(both, "h", "left_semi").select("h", "sid", "n", "pos", "prev"), "met")
    for x in (count, meet, both):
        release(x)
    return met


def _whole_sets(df: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(sid, n, hist, hashes) of the wanted sets, from the texts of one row each. hist: how many hashes
    there are in each of CLASSES classes."""
    importable(df.sparkSession)
    keys = materialise(wanted.select(F.col("least").alias("_gl_key"), F.col("sid").alias("w")), "wanted")
    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(sent(keys.select(F.col("_gl_key").alias("key")).distinct()), "key", "left_semi")
    kind = dict(df.dtypes)[key]
    shift = U(64 - CLASSES.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at, 1 << 20):
                words, first = word_hashes(data, at[i : j + 1], NOT_WHITE)
                with np.errstate(over="ignore"):
                    sets = list(shingles(words, first, k))
                    ids = np.array([name_of(s)[0] for s in sets], U).view(np.int64)
                hist = np.array([np.bincount((s >> shift).astype(np.int64), minlength=CLASSES) for s in sets], np.int32).reshape(-1)
                hist = pa.ListArray.from_arrays(pa.array(np.arange(0, CLASSES * len(sets) + 1, CLASSES, dtype=np.int32)), pa.array(hist))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), hist, _lists(sets)], names=["key", "sid", "n", "hist", "hashes"])

    found = texts.mapInArrow(run, f"key {kind}, sid bigint, n bigint, hist array<int>, hashes array<bigint>")
    # a repeated key may bring other texts, and repeated rows the same set again
    found = found.join(keys, (found["key"] == keys["_gl_key"]) & (found["sid"] == keys["w"]), "left_semi").select("sid", "n", "hist", "hashes")
    return materialise(found, "whole") if few_rows(df.groupBy(f"`{key}`").count().where("count > 1"), 0) else materialise(found.dropDuplicates(["sid"]), "whole")


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link. Histograms bound the intersection first, so that few
    pairs carry sets."""
    side = lambda name, n, x, y: whole.select(F.col("sid").alias(name), F.col("n").alias(n), F.col(x).alias(y))
    near = pairs.join(side("a", "n1", "hist", "x"), "a").join(side("b", "n2", "hist", "y"), "b").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    most = F.aggregate(F.zip_with("x", "y", lambda u, v: F.least(u, v)), F.lit(0), lambda s, v: s + v)
    near = materialise(near.where(linked(most, F.col("n1"), F.col("n2"), percent)).select("a", "b"), "near")
    both = near.join(side("a", "n1", "hashes", "x"), "a").join(side("b", "n2", "hashes", "y"), "b")
    return both.where(linked(F.size(F.array_intersect("x", "y")), F.col("n1"), F.col("n2"), percent)).select("a", "b")


def _named(df: DataFrame, text: str, k: int) -> DataFrame:
    """df with the sid and check of each row's set, as _gl_sid and _gl_check."""
    importable(df.sparkSession)
    place = df.columns.index(text)
    schema = StructType([*df.schema.fields, StructField("_gl_sid", LongType()), StructField("_gl_check", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(place))
            for i, j in blocks(at):
                words, first = word_hashes(data, at[i : j + 1], NOT_WHITE)
                with np.errstate(over="ignore"):
                    names = np.array([name_of(s) for s in shingles(words, first, k)], U).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(names[:, 0]), pa.array(names[:, 1])], names=schema.names)

    return df.mapInArrow(run, schema)


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """df with the rows of each component whose key is the component; same columns.

    Rows without shingles and rows with null keys stay. Of a repeated key only the rows go whose own
    text is in the component of a smaller key.
    """
    own = F.col(f"`{key}`") == F.col("_gl_key")
    gone = _placed(df, key, text, k, percent).where("component <> key").select(F.col("key").alias("_gl_key"), F.col("sid").alias("_gl_sid"), F.col("check").alias("_gl_check"))
    gone = materialise(gone, "gone")
    keys = sent(gone.select("_gl_key"))
    again = df.select(F.col(f"`{key}`").alias("_gl_again")).join(keys, F.col("_gl_again") == F.col("_gl_key"), "left_semi").groupBy("_gl_again").count().where("count > 1").select(F.col("_gl_again").alias("_gl_key"))
    again = materialise(again, "again")
    kept = df.join(keys, own, "left_anti")
    if few_rows(again, 0):
        return kept
    named = _named(df.join(sent(again), own, "left_semi"), text, k)
    sets = sent(gone.select(F.col("_gl_key"), F.col("_gl_sid").alias("_gl_s"), F.col("_gl_check").alias("_gl_c")))
    rest = named.join(sets, own & (F.col("_gl_sid") == F.col("_gl_s")) & (F.col("_gl_check") == F.col("_gl_c")), "left_anti")
    return kept.unionByName(rest.drop("_gl_sid", "_gl_check"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at similarity 0.9 or more over 3-word shingles."""
    return join(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))

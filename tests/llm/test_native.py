"""Sharding, line dedup and exact dedup against plain Python."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, line_dedup, sharding

SCHEMA = "doc_id long, text string, extra string"
ODD = [
    (1, "", "a"), (2, None, "b"), (3, "A b\nc", "c"), (4, "a  B\n\tc\n", "d"), (5, "x" * 50_000, "e"),
    (5, "x" * 50_000, "e"), (None, "Zeile É\nzwei", "f"), (None, None, "g"), (7, "\n\n", "h"), (8, "A b\nc", "i"), (9, "A b\n c ", "j"),
]


def white(s):
    return re.sub(r"[\x20\x09-\x0D]", "", s or "")


def test_exact_groups(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(ODD)
    groups = {}
    for k, t, _ in ODD:
        groups.setdefault(white(t), []).append((-len(t or ""), k is None, k))
    want = sorted((str(k), str(min(groups[white(t)])[2]), len(groups[white(t)])) for k, t, _ in ODD)
    assert sorted((str(r.key), str(r.keep_key), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_drop_copies(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(white(r.text) for r in rows) == sorted({white(t) for _, t, _ in ODD})
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_exact_both_ways(spark, monkeypatch, limit):
    """Few prefix groups are sent to all tasks, many are joined: same result."""
    monkeypatch.setattr(exact_dedup, "SENT_PAIRS", limit)
    df = spark.createDataFrame([(i, f"text {i % 7}" + " " * (i % 3), "") for i in range(60)], SCHEMA)
    got = {r.key: (r.keep_key, r.group_size) for r in exact_dedup.exact_groups(df).collect()}
    for i in range(60):
        same = [j for j in range(60) if j % 7 == i % 7]
        assert got[i] == (min(same, key=lambda j: (-(j % 3), j)), len(same))


def plain_lines(rows, threshold):
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    count = {}
    for _, t, _ in rows:
        for k in set(keys(t)):
            count[k] = count.get(k, 0) + 1
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if not k or count[k] < threshold]
        yield str(i), len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("threshold", [2, 3])
def test_line_dedup(spark, threshold):
    rows = [*ODD, *[(i, f"common É\nown {i}\n Common É \nTail", "k") for i in range(20, 32)], (40, "\n".join(f"n{i % 40}" for i in range(3000)), ""), (41, "n1\nn2\r\n", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.drop_common_lines(df, threshold=threshold)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == sorted(plain_lines(rows, threshold))
    assert line_dedup.drop_common_lines(df.limit(0), threshold=threshold).count() == 0


def test_line_dedup_without_ansi(spark):
    """size() of null is -1 in that mode; nothing dropped is 0."""
    rows = [(1, "a\nb", ""), (2, None, ""), (3, "a\na\nc", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = line_dedup.drop_common_lines(df, threshold=2, batches=2).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == [(1, 2, 1, "b"), (2, 1, 0, ""), (3, 3, 2, "c")]


@pytest.mark.parametrize("batches", [1, 7, 100])
def test_line_dedup_batches(spark, batches):
    """Any number of batches, empty ones too, gives the same lines."""
    rows = [(i, f"common {i % 5}\nrare {i % 31}\nown {i}", "") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = line_dedup.drop_common_lines(df, threshold=4, batches=batches).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == sorted(plain_lines(rows, 4))


def test_line_runs_levels(spark):
    """Batches one after another give the counts of all at once, through compactions."""
    index = line_dedup.LineRuns(spark, threshold=3, fanout=2)
    for b in range(5):
        index.add(spark.createDataFrame([(k, 0) for k in range(6) if (k + b) % 3 or k == 1], "h long, c int"))
    assert len(index.levels) >= 3 and all(len(x) < 2 for x in index.levels)
    assert len(index.known) <= 5  # found in batches and merges, brought together
    want = [k for k in range(6) if sum(bool((k + b) % 3 or k == 1) for b in range(5)) >= 3]
    assert sorted(r.h for r in index.common().collect()) == want


@pytest.mark.parametrize("n,shards", [(0, 4), (3, 4), (1000, 7), (4001, 40)])
def test_sharding(spark, n, shards):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit("y").alias("_rank"))
    rows = sharding.shard(df, shards=shards).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    sizes = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding_moves_little(spark):
    """Most keys stay in their own arc, and one more shard moves a minority of rows."""
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.shard for r in sharding.shard(df, shards=40).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(df, shards=41).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)


def test_sharding_odd_rows(spark):
    df = spark.createDataFrame([(None, "a", ""), (None, "a", ""), (1, None, ""), (1, None, "")], SCHEMA)
    rows = sharding.shard(df, shards=2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize("hot", [0, 2000])
def test_sharding_groups(spark, hot):
    """Each shard takes its groups whole but where it is full; a group of over a third of all rows,
    dealt in parts, takes the room that the keys of their own arcs leave."""
    rows = [(i, f"group {i % 500}") for i in range(4000)] + [(10_000 + i, "hot") for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df, shards=12, group="text").collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    sizes = [sum(r.shard == s for r in got) for s in range(12)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(12):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    # a shard is left unfinished by one group on its own arc and by one that overflowed into it
    assert sum(len(x) - 1 for t, x in where.items() if t != "hot") <= 24
    assert not hot or len(where["hot"]) >= 4
    again = sharding.shard(df.repartition(3, "text"), shards=12, group="text").collect()
    assert {r.doc_id: (r.shard, r.slot) for r in again} == {r.doc_id: (r.shard, r.slot) for r in got}


@pytest.mark.parametrize("hot", [0, 900])
def test_sharding_brute_force(spark, hot):
    """Rows one at a time around the ring, in the operator's order of cells, then of ranks."""
    n, shards, cells = 1500, 6, 64
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < hot, 0).otherwise(F.col("id")).alias("g"))
    cell = F.pmod(F.xxhash64("g"), F.lit(cells)).cast("int")
    got = sharding.shard(df, shards=shards, cells=cells, nodes=4, group="g").withColumn("cell", cell).collect()
    owner = sharding.ring(shards, cells, 4)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    count, want = {}, {}
    for r in got:
        count[r.cell] = count.get(r.cell, 0) + 1
    left = {}
    for c in sorted(count):
        for _ in range(count[c]):
            full = not room[owner[c]]
            left[c] = left.get(c, 0) + full
            if not full:
                room[owner[c]] -= 1
                want[c, owner[c]] = want.get((c, owner[c]), 0) + 1
    for c in sorted(left):
        for _ in range(left[c]):
            step = c
            while not room[owner[step]]:
                step = (step + 1) % cells
            room[owner[step]] -= 1
            want[c, owner[step]] = want.get((c, owner[step]), 0) + 1
    have = {}
    for r in got:
        have[r.cell, r.shard] = have.get((r.cell, r.shard), 0) + 1
    assert have == want


def test_op3_columns(spark):
    rows = sharding.op3_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None

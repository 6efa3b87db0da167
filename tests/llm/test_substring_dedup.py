"""Substring dedup against all runs of words of the corpus."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, width):
    docs = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in docs for i in range(len(w) - width + 1))
    for (key, _), w in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield str(key), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def corpus(seed, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "b", "é", "c,", "dd", "ee.", "\x85", "漢"])
    prose = lambda n: "".join(word() + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for _ in range(n))
    passage = prose(3 * width).split(" ")
    texts = ["", None, " \n", "x", "x " * (width - 1), "x " * width, "x " * (3 * width), prose(width)]
    texts += [prose(rng.randint(0, 5 * width)) for _ in range(15)]
    for _ in range(25):
        a = rng.randint(0, len(passage) // 2)
        texts.append(prose(rng.randint(0, width)) + " ".join(passage[a : a + rng.randint(width // 2, len(passage))]) + " " + prose(rng.randint(0, width)))
    base = prose(6 * width).split(" ")
    for _ in range(10):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        texts.append(" ".join(t))
    texts += [texts[-1], texts[-1]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, (5, rows[5][1]), (None, " ".join(passage)), (None, None), (7, " ".join(base))]


@pytest.mark.parametrize("seed,width,gram", [(1, 9, 3), (2, 20, 7), (3, 12, 12), (4, 8, 6)])
def test_exact(spark, seed, width, gram):
    rows = corpus(seed, width)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("kept"), F.lit(0).alias("u"), F.lit(1).alias("key"), F.lit(2).alias("list"))
    got = sd.drop_repeats(df, width=width, gram=gram).collect()
    assert sorted((str(r.key), r.n_words, r.n_removed, r.kept) for r in got) == sorted(brute(rows, width))
    for r in got:
        assert sum(x["e"] - x["s"] for x in r.ranges) == r.n_removed
        assert all(x["e"] - x["s"] >= width for x in r.ranges)
        assert all(x["e"] < y["s"] for x, y in zip(r.ranges, r.ranges[1:], strict=False))


def test_production_width(spark):
    rng = random.Random(5)
    prose = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    p = prose(60)
    # the same passage in many documents, each time with other words around it
    rows = [(i, " ".join(prose(rng.randint(1, 40)) + p[: 34 + i % 20] + prose(rng.randint(1, 40)))) for i in range(300)]
    rows += [(300, " ".join(p[:34])), (301, " ".join(prose(2000) + p[20:55] + prose(100))), (302, " ".join(prose(5000)))]
    got = sd.drop_repeats(spark.createDataFrame(rows, SCHEMA), digest=True).collect()
    want = {(k, a, b, hashlib.sha256(t.encode()).hexdigest()) for k, a, b, t in brute(rows, 35)}
    assert {(str(r.key), r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_slices(spark, monkeypatch):
    """A text of many slices, of which another holds a part that reaches over an edge."""
    rng = random.Random(6)
    long = [str(rng.randrange(10**9)) for _ in range(3000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[980:1100]))]
    first = np.array([0, 3000])
    monkeypatch.setattr(sd, "SLICE", 1000)
    parts = [x for x in sd.slices(np.arange(3000), first, 35)]
    assert [len(p[1]) for p in parts] == [1034, 1034, 1000]
    monkeypatch.undo()
    got = {r.key: [tuple(x) for x in r.ranges] for r in sd.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [(980, 1100)], 2: [(0, 120)]}


def test_halvings():
    for places in (1, 3, 4, 20, 24, 25):
        steps = sd.halvings(places)
        assert len(steps[-1]) >= places and all(len(b) % len(a) == 0 for a, b in zip(steps, steps[1:], strict=False))
        assert all(r == list(dict.fromkeys(r)) and r[0][0] == 0 for r in steps)


def test_empty_table(spark):
    assert sd.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0

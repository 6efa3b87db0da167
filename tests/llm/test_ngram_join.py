"""The grouped prefix join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import ngram_join
from gridloom.llm._graph import components


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def family(rng, words, n, size, edits, hub=True):
    base = [rng.choice(words) for _ in range(size)]
    out = [" ".join(base)] * hub
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = [rng.choice(words)]
        out.append(" ".join(t))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = ["", None, "  \n", "a", "A", "a b", "a b c", "a  B\tc", "É b", "é b"]
    for n, size, edits, hub in ((40, 60, 3, True), (25, 120, 8, False), (6, 30, 2, True), (12, 15, 2, True), (30, 200, 6, False)):
        texts += family(rng, words, n, size, edits, hub)
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(30)]
    texts.append("very long " * 3000)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,k,percent,small", [(1, 3, 90, 320), (2, 3, 90, 60), (3, 5, 80, 40), (4, 3, 90, 1)])
def test_join_is_exact(spark, monkeypatch, seed, k, percent, small):
    # bands begin at small sizes, so that parts of the shingles, lists in two bands and the return to all shingles occur
    monkeypatch.setattr(ngram_join, "BANDS", (0, *(small << i for i in range(8))))
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("sid", F.lit(1))
    got = {r.key: (r.n_shingles, r.component) for r in ngram_join.join(df, k=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_parts_hold_prefixes(percent):
    for least in ngram_join.BANDS:
        share = ngram_join.share_of(least, percent)
        assert share == 1 or least * share > ngram_join.prefix_of(least, percent)
    assert ngram_join.share_of(100_000, percent) < 0.6 and ngram_join.share_of(0, percent) == 1


def test_odd_keys(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "other words of it"), (3, "other words of it"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.key, r.component) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(None, None), (5, 5), (5, 5), (5, 3), (3, 3), (9, 9)], key=str)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_drop_near_copies(spark):
    rows = corpus(7)[:150]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns
    want = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_drop_near_copies_of_repeated_keys(spark):
    rows = [(5, "a b c d"), (5, "other words of it"), (3, "other words of it"), (5, None), (5, "a b c d"), (7, "other words of it"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash"))
    kept = ngram_join.drop_near_copies(df)
    want = [(5, "a b c d"), (3, "other words of it"), (5, None), (5, "a b c d"), (None, "a b c d")]
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(200, 200 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_copies_that_cannot_link_are_not_paired(spark, monkeypatch):
    # 40 texts of 400 words with eight words of their own each: in the part of the shingles few of those are seen
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        t = list(base)
        for j in rng.sample(range(0, 400, 4), 8):
            t[j] = f"own{i}x{j}"
        rows.append((i, " ".join(t)))
    looked, verified = [], ngram_join._verified

    def spy(pairs, *rest):
        looked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", spy)
    got = {r.key: (r.n_shingles, r.component) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90)
    assert looked[-1] <= len(rows)

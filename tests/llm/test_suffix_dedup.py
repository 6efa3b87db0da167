"""Suffix dedup against all strings of the corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import suffix_dedup as sd


def brute(rows, length):
    count = {}
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    for (key, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone[1:] & ~gone[:-1])) + int(gone[0])
        yield str(key), len(r), int(gone.sum()), spans, bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(30), prose(120)
    texts = ["", None, "x", "ab" * 300, "a" * 500, "a" * 39, "a" * 40, "a" * 41]
    texts += [prose(rng.randint(1, 80)) for _ in range(25)]
    texts += [prose(rng.randint(0, 20)) + passage[rng.randint(0, 60) :] + prose(rng.randint(0, 20)) for _ in range(20)]
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        texts.append("".join(t))
    texts += [base, base, passage + passage]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, (5, rows[5][1]), (None, passage), (None, None)]


@pytest.mark.parametrize("seed,group", [(1, 8000), (2, 3), (3, 1)])
def test_exact(spark, seed, group):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("u", F.lit(0))
    got = sd.repeats(df, length=40, gram=12, group=group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute(rows, 40))
    for r in got:
        assert sum(s["e"] - s["s"] for s in r.spans) == r.n_removed


def test_production_length(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    p = text(450)
    rows = [(1, text(300) + p + text(900)), (2, p), (3, text(2000)), (4, text(100) + p[:399] + text(10)), (5, text(60_000) + p[20:430])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute(rows, 400))
    assert sd.repeats(df.limit(0)).count() == 0


def test_ranks_are_the_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 300).astype(np.uint8)
    raw = data.tobytes()
    for length in (8, 12, 40, 400):
        rank = sd.ranks(data, length)
        want = sorted(range(300), key=lambda i: raw[i : i + length].ljust(length, b"\0"))
        assert [raw[i : i + length] for i in np.argsort(rank, kind="stable")] == [raw[i : i + length] for i in want]


def test_drop_repeats(spark):
    rows = [r for r in corpus(4) if r[0] is not None]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, kept string")
    out = sd.drop_repeats(df, length=40)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows) and all((r.text is None) == (t is None) for r, t in [(g, dict(rows)[g.doc_id]) for g in got])
    assert all("�" not in (r.text or "") for r in got)

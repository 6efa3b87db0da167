"""The network: gradients against differences, coverage of windows, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["zorkel", "vrump", "quizzan"]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 2)):
                t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(["", "s", "en"]))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_windows_cover():
    for n in range(300):
        s = tx.windows(n)
        seen = {w for a in s.tolist() for w in range(a, min(a + tx.WINDOW, n))}
        assert seen == set(range(n)) and all(a < n for a in s.tolist())


def test_every_run_of_words_is_a_window():
    for n in (1, 31, 32, 33, 100, 1000):
        assert tx.windows(n).tolist() == list(range(max(1, n - tx.WINDOW + 1)))
    assert len(tx.windows(0)) == 0


def test_place_in_a_long_text_does_not_matter():
    net = tx.train(*corpus(60, 4))
    texts, _ = corpus(40, 5)
    run = " ".join(" ".join(texts).split()[: tx.WINDOW])
    alone = net.score([run])[0]
    for before in (1, 7, 13, 40):
        assert net.score(["x " * before + run + " x" * 50])[0] >= alone - 1e-5


def test_gradients():
    texts, labels = corpus(6, 1)
    each, rows, tri = tx.split_words(texts)
    net = tx.Network(each[:40], np.zeros(40, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    at, mask = tx.gather(np.concatenate(rows), starts[:-1], np.minimum(7, np.diff(starts)))
    own, inner = np.unique(at, return_inverse=True)
    sub = [np.concatenate([tri[0][tri[1][w] : tri[1][w + 1]] for w in own]), np.concatenate(([0], np.cumsum(np.diff(tri[1])[own])))]
    y, weight = np.array(labels, float), np.ones(6)

    def loss():
        x, _ = net.vectors(each[own], sub)
        z = net.logits(x, inner.reshape(at.shape), mask).astype(float)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    x, place = net.vectors(each[own], sub)
    g = net.gradients(x, place, sub, inner.reshape(at.shape), mask, y, weight, np.ones_like(x))
    rng = np.random.default_rng(0)
    for name, p in net.p.items():
        flat, grad = p.reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[: 3 if len(flat) > 1 else 1].tolist() + rng.integers(0, len(flat), 1).tolist():
            if name == "word" and i < tx.WORD_DIM:
                continue
            old, h = flat[i], 3e-3
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / (2 * h), rel=0.08, abs=2e-4), name


def test_learns_and_generalises():
    net = tx.train(*corpus(400, 2))
    texts, labels = corpus(200, 3)
    p = net.score(texts)
    assert np.mean((p >= 0.5) == np.array(labels)) > 0.95
    assert np.array_equal(net.score(texts[:50]), p[:50]) or np.allclose(net.score(texts[:50]), p[:50], atol=1e-5)
    # one bad word anywhere in a very long text
    long = texts[1] + " filler words only" * 20_000
    assert net.score([long])[0] < 0.5 and net.score([long + " zorkel end"])[0] > 0.5
    again = tx.train(*corpus(400, 2))
    assert np.array_equal(again.score(texts), p)


def test_no_labels_and_odd_rows(spark):
    assert tx.train([], []) is None and tx.train(["a"], [1]) is None
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "...", "y")], "doc_id long, text string, score string")
    net = tx.train(*corpus(60, 4))
    got = tx.score_documents(docs, net).collect()
    assert len(got) == 5 and [r.score for r in got if r.key in (1, 2, None)] == [0.0] * 3
    assert all(r.score == 0 for r in tx.score_documents(docs, None).collect())
    assert tx.drop_toxic(docs, None).collect() == docs.collect()
    assert tx.score_documents(docs.limit(0), net).count() == 0


def test_held_out_and_drop(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = tx.fit(docs, labels)
    rows = tx.score_documents(docs, net).join(labels, F.col("key") == F.col("doc_id")).collect()
    held = [r for r in rows if tx.is_held_out(r.doc_id)]
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.9
    kept = tx.drop_toxic(docs, net)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < 0.5 for r in tx.score_documents(docs, net).collect())


def test_learns_in_a_task(spark, monkeypatch):
    """The driver collects no texts and trains nothing."""
    texts, labels = corpus(60, 4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")

    def here(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(tx, "split_words", here)  # workers have their own
    net = tx.fit(docs, known)
    monkeypatch.undo()
    sample = sorted(i for i in range(len(texts)) if not tx.is_held_out(i))
    score = net.score([texts[i] for i in sample])
    assert np.mean([(s >= 0.5) == bool(labels[i]) for s, i in zip(score, sample, strict=True)]) > 0.9
    assert tx.fit(docs.limit(0), known) is None

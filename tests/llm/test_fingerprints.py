"""Fingerprints against plain Python over the whole table."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints as fp


def words(t):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))


def test_term_counts(spark):
    df = spark.createDataFrame([("a b A",), ("b É",), (None,), ("",), ("b " * 30_000,)], "text string")
    assert sorted(r.n for r in fp.term_counts(df).collect()) == [1, 1, 3]
    assert fp.term_counts(df.limit(0)).count() == 0


def test_lexicon_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect()]
    count = {}
    for t in texts:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    want = sum(max(2, fp.LOW * len(texts)) <= n <= fp.HIGH * len(texts) for n in count.values())
    assert len(fp.lexicon(docs)) == want


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_against_plain(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 90").select("doc_id", "text", F.lit(1).alias("key"))
    docs = docs.unionByName(spark.createDataFrame([(None, "null key"), (None, None), (500, ""), (501, None), (502, "xyzzy"), (503, "xyzzy"), (503, "xyzzy"), (504, "only 😀 here " * 9000)], "doc_id long, text string").withColumn("key", F.lit(2)))
    terms = fp.lexicon(docs)
    got = fp.compare_with_next(docs, terms, parts=parts).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        want.append((str(k), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.key), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    maker = fp.Fingerprinter(terms)
    alone = {str(k): fp.shown(maker.hashes([t]))[0] for k, t in rows if k is not None}
    for r in got:
        assert r.key is None or r.fingerprint == alone[str(r.key)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.key: r for r in got}
    assert by[502].fingerprint == by[503].fingerprint and by[500].fingerprint == by[501].fingerprint
    assert by[503].near_next == 1.0
    own = [r for r in got if r.key is not None and r.key < 90]
    assert np.mean([r.near_edited for r in own]) > np.mean([r.near_next for r in own]) + 0.2


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    terms = fp.lexicon(df)
    got = fp.compare_with_next(df, terms).collect()
    assert len(got) == 1 and got[0].edited_sha256 == hashlib.sha256(b"abc d" + b"ab").hexdigest()
    assert fp.compare_with_next(df.limit(0), terms).count() == 0


def test_subsets_change_with_terms():
    terms = np.sort(fp.seeds(500, 99))
    maker = fp.Fingerprinter(terms)
    assert 200 < (maker.values[0] > 0).sum() < 300 and (maker.values[-1] > 0).sum() < 20

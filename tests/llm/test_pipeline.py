"""The pipeline's stages against plain Python, and what must not depend on the subpackage."""

import re
import subprocess
import sys

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridloom.llm import toxicity
from gridloom.llm._common import CLEANUP, materialise, release

D = "/root/testdata/sf0.001"


def near_links(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in keys}


def without_passages(texts, length):
    count = {}
    raws = {k: t.encode() for k, t in texts.items()}
    for r in raws.values():
        for i in range(len(r) - length + 1):
            h = hash(r[i : i + length])
            count[h] = count.get(h, 0) + 1
    for k, r in raws.items():
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[hash(r[i : i + length])] > 1:
                gone[i : i + length] = True
        yield k, gone, r


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "suffix_dedup", "packing"]
    stage = dict(cp.STAGES)

    net = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    clean = stage["toxicity"](spark, docs, D)
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = dict(zip(texts, net.score(list(texts.values())), strict=True)) if net else dict.fromkeys(texts, 0.0)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == names and all((k in kept) == (s < 0.5) for k, s in scores.items() if abs(s - 0.5) > 1e-3)

    exact = stage["exact_dedup"](spark, docs, D)
    best = {}
    for k, t in texts.items():
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[n] = min(best.get(n, (1, 0)), (-len(t), k))
    assert exact.columns == names and {r.doc_id for r in exact.collect()} == {k for _, k in best.values()}

    near = stage["ngram_join"](spark, docs, D)
    assert near.columns == names and {r.doc_id for r in near.collect()} == {k for k, c in near_links(texts).items() if k == c}

    cut = stage["suffix_dedup"](spark, docs, D)
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == names and set(got) == set(texts)
    for k, gone, raw in without_passages(texts, cp.PASSAGE):
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        # whole characters stay: at most 3 bytes more at each edge of a span
        spans = int(np.sum(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        assert 0 <= len(got[k].text.encode()) - len(left) <= 6 * spans and got[k].n_chars == len(got[k].text)


def test_run(spark):
    rows = cp.run(spark, D)
    pieces = rows.collect()
    assert pieces and max(r.offset + r.length for r in pieces) <= 1024
    seen = {}
    for r in pieces:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert all(seen[r.doc_id] == r.doc_tokens for r in pieces)


def test_empty_and_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0, name
        assert stage(spark, docs, D).count() > 0, name


def test_rest_imports_without_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "gridloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 80 and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in e.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=cp.__file__.rsplit("/", 1)[0])
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["op1_ngram_join", "op8_suffix_dedup", "op5_fingerprints", "op4_license_scan", "op10_toxicity", "pipeline"])
def test_registered(name):
    import __spark_entry__ as e

    assert name in e.queries()


def test_written_steps_leave_no_shuffle_files(spark):
    """What a step shuffled goes when it is written, whenever the driver collects its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before, held = files(), spark.conf.get(CLEANUP)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    made = materialise(df.join(df.withColumnRenamed("count", "n").hint("merge"), "k"), "test")
    assert not files() - before and spark.conf.get(CLEANUP) == held
    assert made.count() == 7
    release(made)

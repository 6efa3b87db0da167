"""Source divergence audit against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import divergence as dv

SCHEMA = "lang string, source string, text string"


def terms(t):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, least):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms(text)
        docs[lang].update(set(found))
        count[lang, source].update(found)
        groups[lang].add(source)
    for lang, own in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        total = Counter()
        for s in own:
            total.update({t: count[lang, s][t] for t in kept})
        share = lambda c, kept=kept, v=v: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * v) for t in kept}
        p, q = {s: share(count[lang, s]) for s in own}, share(total)
        for s in own:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:50])):
                for rank, (value, _, item) in enumerate(items, 1):
                    yield lang, s, part, item, -value, rank


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "é", "Straße", "x1", "漢字", "don't", "ZZ", "zz"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "É", "z", "", None])
        weights = [1 + (zlib.crc32(f"{w}{source}".encode()) % 7 == 0) * 5 for w in vocabulary]
        rows.append((rng.choice(["en", "en", "de", "", None]), source, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))))
    return [*rows, ("xx", "s0", None), ("xx", "s1", ""), ("yy", "alone", "a a a"), ("en", "s9", None), ("en", "s0", "long " * 30_000), rows[0], rows[0]]


def as_set(df):
    out = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(out)) == len(out)
    return set(out)


def test_exact(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("term"), F.lit("x").alias("n"), F.lit(0).alias("block")).repartition(5)
    want = set(brute(rows, 20))
    assert as_set(dv.audit(df, least_docs=20)) == want
    # many small blocks: partial sums and heaps are merged
    assert as_set(dv.audit(df, least_docs=20, cells=40)) == want


def test_no_kept_terms(spark):
    df = spark.createDataFrame([("a", "s", "x"), ("a", "t", "y"), ("a", "u", None)], SCHEMA)
    got = as_set(dv.audit(df))
    assert got == set(brute([tuple(r) for r in df.collect()], 30)) and len(got) == 6 and all(v == 0 for *_, v, _ in got)
    assert dv.audit(df.limit(0)).count() == 0


def test_heaps_of_many_terms():
    values = np.array([3, 0, 5, 5, -1, 3, 9] * 40)
    want = sorted([i for i, v in enumerate(values) if v > 0], key=lambda i: (-values[i], i))[:50]
    assert dv.best(values, 50).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9 * 10**15 - 1), st.integers(0, 9 * 10**15))
def test_shares(total, count):
    count = min(count, total)
    assert dv.shares(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * count // total]


def test_pair_sums():
    p = np.random.default_rng(1).integers(0, 10**9, (17, 31))
    for i, sums in dv.pair_sums(p):
        assert sums.tolist() == [int(np.abs(p[i] - p[j]).sum()) for j in range(i + 1, 17)]

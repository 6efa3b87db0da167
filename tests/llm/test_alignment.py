"""Alignment of two tokenizers against byte offsets, and its counts against plain Python."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import alignment as al

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", None, " ", "  ", "\n", "Hello  world é\n x <s> </s><|endoftext|>", "▁x a", "a ▁", "A\xa0 b　 c   d", "été à la  plage , 'll 's",
    "漢字 かな 😀 😀😀 ǅ ﬁ", "\x00 a\x00b", "a" * 5000, "x " * 3000 + "é", "it's 12345  67 ½", "\t\t a \n\n  b\r\n c", "é é", " lead", "trail ", "🏽 ok",
]
CHARS = st.lists(st.sampled_from([*"aeinrst ES'.,!\n\t0129éßñ’漢😀▁", "'s", "the", "  ", "\xa0 ", "́"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    of = {(chr(i) if i in shown else chr(next(other))): i for i in range(256)}

    def one(text):
        """(A ids, B ids, groups, links) by byte offsets."""
        if not text:
            return [], [], [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raws = [[bytes(of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if any(b"".join(r) != (" " + text).encode() for r in raws):
            return [], [], [], []
        ends = [list(itertools.accumulate(map(len, r))) for r in raws]
        cut = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
        at = [(0, 0), *((cut[0][e], cut[1][e]) for e in ends[0] if e in cut[1])]
        groups = [(ids[0][p[0] : q[0]], ids[1][p[1] : q[1]]) for p, q in zip(at, at[1:], strict=False)]
        links, i, j = [], 0, 0
        begins = [[0, *e[:-1]] for e in ends]
        while i < len(ids[0]) and j < len(ids[1]):
            if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]:
                links.append((ids[0][i], ids[1][j]))
            if ends[0][i] <= ends[1][j]:
                i, j = i + 1, j + (ends[0][i] == ends[1][j])
            else:
                j += 1
        return *ids, groups, links

    return one


def rows(texts):
    raw = [(t or "").encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    own = al.aligner(A, B)
    return [(a, b, g, x, sorted(divmod(c, own.width) for c in codes.tolist())) for a, b, g, x, codes in own.rows(np.frombuffer(b"".join(raw), np.uint8), at)]


def same(plain, texts):
    for t, (n_a, n_b, n, said, links) in zip(texts, rows(texts), strict=True):
        a, b, groups, want = plain(t)
        assert (n_a, n_b, n) == (len(a), len(b), len(groups)), t
        assert said == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert links == sorted(want), t


def test_odd(plain):
    same(plain, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(CHARS, max_size=5))
def test_any(plain, texts):
    same(plain, texts or [""])


def test_transducer():
    t = al.Transducer([b" a", b"bc", b"d", b" abcd"], [b" ", b"abcd", b" ab", b"c", b"d"])
    assert t.run([0, 1, 2], [0, 1]) == ([([0, 1, 2], [0, 1])], [(0, 0), (0, 1), (1, 1), (2, 1)])
    assert t.run([0, 1, 2], [2, 3, 4]) == ([([0, 1], [2, 3]), ([2], [4])], [(0, 2), (1, 2), (1, 3), (2, 4)])
    assert t.run([], []) == ([], [])
    with pytest.raises(ValueError):
        t.run([0], [1])


def brute(plain, table):
    found = [plain(t) for _, t in table]
    count = Counter(x for f in found for x in f[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for (key, _), (a, b, groups, links) in zip(table, found, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(count[x] == most[x[1]] for x in links)
        yield str(key), len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if said else "", best, sum(count[x] for x in links)


def test_documents(spark, plain):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table += [(i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, "no key"), (None, None)]
    df = spark.createDataFrame(table, "doc_id long, text string").select("*", F.lit("clash").alias("groups"), F.lit(1).alias("uid"), F.lit(2).alias("pair"))
    want = sorted(brute(plain, table))
    for sent in (0, 10**6):  # pairs of ids are joined by shuffle, or sent to all tasks
        got = al.align(df.repartition(4), A, B, digest=True, sent=sent).collect()
        assert sorted((str(r.key), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got) == want
    assert al.align(df.limit(0), A, B).count() == 0


def test_groups(spark, plain):
    table = [(1, "Hello worldly things"), (2, None)]
    got = {r.key: [(g.a, g.b) for g in r.groups] for r in al.align(spark.createDataFrame(table, "doc_id long, text string"), A, B).collect()}
    assert got == {1: [tuple(g) for g in plain("Hello worldly things")[2]], 2: []}


def test_bounds(plain, monkeypatch):
    """Units and transitions beyond what is kept: same rows."""
    monkeypatch.setattr(al, "KEPT_UNITS", 20)
    monkeypatch.setattr(al, "KEPT_MOVES", 5)
    al.aligner.cache_clear()
    same(plain, ["one two three four " * 5, "five six seven eight nine ten " * 4, *ODD])
    al.aligner.cache_clear()

"""BPE and packing against the tokenizers library and brute force."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import bpe, packing

ODD = [
    "It's we'll 'S a''s \"'s I'm x'rex  \n\n y  ", "", "<|endoftext|> Hello<|startoftext|>x", "ΑΣ Σας ǅ ﬁ 12345 ½ ² á  x",
    "\x1c\x1dA\x00 ​ zw 漢字かな 😀!!", "a\n", "\n \n a 's 'll't", " ", "...'s'd 'd''t 12a3 a12", "É" * 3000, "x'", "'", "''s 'r e",
]
CHARS = st.lists(st.sampled_from([*"aeinrst ES'.,!\n\t0129éßñ’", "'s", "'re", "the", "  "]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def word():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.WordBPE(path), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def byte():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.ByteBPE(path), Tokenizer.from_file(path)


def same_words(word, texts):
    own, lib = word
    for got, want in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got[0].tolist() == want.ids
        assert got[1] == own.decode(want.ids) == lib.decode(want.ids, skip_special_tokens=False)


def same_bytes(byte, texts):
    own, lib = byte
    for got, want in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_odd(word, byte):
    same_words(word, ODD)
    same_bytes(byte, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(CHARS, max_size=5))
def test_any(word, byte, texts):
    same_words(word, texts)
    same_bytes(byte, texts)


def test_documents(spark, word, byte):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same_words(word, texts)
    same_bytes(byte, texts)


def test_full_tables(word, monkeypatch):
    """Results don't depend on what a task keeps."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(word[0], "pair_key", np.full(8, -1, np.int64))
    monkeypatch.setattr(word[0], "pair_fit", np.zeros(8, bool))
    same_words(word, ["unbelievable international xqzt lowercasing", *ODD, "unbelievable words again"])


def brute(places, penalty, size):
    best = {0: 0.0}
    for j in range(1, len(places)):
        best[j] = min(best[i] + size - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= size)
    return best[len(places) - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=12), st.sets(st.integers(1, 300), max_size=20))
def test_cuts_are_best(lengths, soft):
    ends = np.cumsum(lengths)
    soft = np.array(sorted(s for s in soft if s < ends[-1]), np.int64)
    places, penalty = packing.candidates(ends, soft, stride=8)
    cuts = packing.best_cuts(places, penalty, size=32)
    at = {p: c for p, c in zip(places.tolist(), penalty.tolist(), strict=True)}
    assert cuts[-1] == ends[-1] and all(b - a <= 32 for a, b in itertools.pairwise([0, *cuts]))
    assert abs(sum(32 - (b - a) + at[b] for a, b in itertools.pairwise([0, *cuts])) - brute(places.tolist(), penalty.tolist(), 32)) < 1e-6


def test_pieces(spark, byte):
    """Each id lies in one piece, sequences are gapless, padding is little, order is kept."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "again"), (99, "word. " * 9000), (99, "word. " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = [[*byte[1].encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    assert [x for r in got for x in r.ids] == [x for w in want for x in w]
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(map(len, want))
    sizes = {}
    for r in got:
        assert r.offset == sizes.get(r.sequence_id, 0) and r.length == len(r.ids)
        sizes[r.sequence_id] = r.offset + r.length
    assert max(sizes.values()) <= packing.SIZE
    assert len(sizes) <= sum(map(len, want)) / packing.SIZE * 1.05 + 1
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_op6(spark, byte):
    rows = packing.op6_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows[:300]:
        ids = np.array([*byte[1].encode(docs[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_op2_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a B")], "doc_id long, text string")
    got = bpe.encode_documents(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert [(r.key, len(r.ids), r.decoded) for r in got[:2]] == [(1, 0, ""), (1, 0, "")] and got[2].decoded == "a</w> b</w>"
    assert bpe.encode_documents(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0

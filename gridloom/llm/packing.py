"""Packing: order-preserving dynamic programming over window cuts.

The documents of a partition, each followed by one end id, form a stream in the table's order. It
is cut into windows of at most ``SIZE`` ids. Cuts may fall at the ends of documents (free), at
sentence ends (``SENTENCE``) or, inside long sentences, every ``STRIDE`` ids (``FORCED``); the cuts
chosen have the least sum of padding and penalties. With f(j) the least cost up to cut j,
f(j) = min(f(i) + c(i)) + SIZE - c(j) + penalty(j) over the cuts i at most SIZE ids back: a sliding
minimum, kept in a monotone queue.

One scan, no shuffle: partitions are packed alone, so each ends in one window that isn't full. The
stream is worked off in blocks; the last window of a block is carried to the next one, so memory
is bounded by a block and the longest document.

Defined results: null and empty texts are a document of the end id alone; very long texts are cut
like others; repeated rows are documents of their own; an empty table gives no rows; other columns
are ignored. Ties between cuts: the earliest cut.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, importable
from ._pretoken import BEYOND, joined, pieces
from ._text import blocks, utf8
from .bpe import byte_alphabet

SIZE = 1024
SENTENCE, FORCED, STRIDE = 4.0, 24.0, 16
END_ID = 0
#: Words whose ids a task keeps.
KEPT_WORDS = 500_000


class ByteBPE:
    """The tokenizers library's byte-level BPE, asked once for each different word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.kept: dict[int, bytes] = {}
        ends = set(".!?\n")
        names = self.full.get_vocab()
        line = byte_alphabet()[10]
        self.sentence = np.zeros(max(names.values()) + 1, bool)
        for token, i in names.items():
            self.sentence[i] = token[-1:] in ends or token.endswith(line)

    def _word(self, raw: bytes) -> bytes:
        return np.array([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if BEYOND.search(t) or any(s in t for s in self.special):
                out[i] = np.array(self.full.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                plain.append(i)
        buf, begin, end, hashes, first = pieces(*joined([texts[i] for i in plain]), blanks=True)
        each, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.kept) + len(each) > KEPT_WORDS:
            self.kept.clear()
        each, kept, raw = each.tolist(), self.kept, buf.tobytes()
        for h, k in zip(each, one.tolist(), strict=True):
            if h not in kept:
                kept[h] = self._word(raw[begin[k] : end[k]])
        ids = [kept[h] for h in each]
        back = back.tolist()
        for i, a, b in zip(plain, first[:-1].tolist(), first[1:].tolist(), strict=True):
            out[i] = np.frombuffer(b"".join([ids[k] for k in back[a:b]]), "<u4")
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, ascending from 0, and their penalties."""
    soft = np.union1d(doc_ends, sentence_ends)
    before = np.concatenate(([0], soft[:-1]))
    extra = np.maximum((soft - before - 1) // stride, 0)
    forced = np.repeat(before, extra) + stride * (np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    places = np.concatenate((soft, forced))
    cost = np.concatenate((np.where(np.isin(soft, doc_ends), 0.0, SENTENCE), np.full(len(forced), FORCED)))
    order = np.argsort(places, kind="stable")
    return np.concatenate(([0], places[order])), np.concatenate(([0.0], cost[order]))


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """The places at which windows end, the last included; windows hold size ids at most."""
    at, cost = places.tolist(), penalty.tolist()
    key = [0.0] * len(at)  # f(i) + c(i)
    back = [0] * len(at)
    queue = deque([0])
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, len(at)):
        c = at[j]
        while at[queue[0]] < c - size:
            popleft()
        i = queue[0]
        back[j] = i
        value = key[j] = key[i] + size + cost[j]
        while queue and key[queue[-1]] > value:
            pop()
        push(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """The stream of one partition: documents go in, windows' pieces come out."""

    def __init__(self, sentence: np.ndarray, first_sequence: int):
        self.sentence, self.sequence = sentence, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # key, ids in all, ids before this part

    def add(self, key: object, ids: np.ndarray) -> None:
        full = np.append(ids, np.uint32(END_ID)).astype("<u4")
        self.ids.append(full)
        self.docs.append((key, len(full), 0))

    def flush(self, final: bool) -> Iterator[tuple]:
        """(key, start, ids, doc_tokens, sequence, offset) of all windows; the last one only if final."""
        if not self.ids:
            return
        stream = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        soft = np.flatnonzero(self.sentence[stream]) + 1
        cuts = best_cuts(*candidates(ends, soft))
        if not final:
            cuts = cuts[:-1]
        begins = ends - [len(x) for x in self.ids]
        last = cuts[-1] if cuts else 0
        edges = np.union1d(np.append(0, cuts), ends[ends <= last])
        doc = np.searchsorted(ends, edges[:-1], "right")
        window = np.searchsorted(cuts, edges[:-1], "right")
        heads = np.append(0, cuts)
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), window.tolist(), strict=True):
            key, total, done = self.docs[d]
            yield key, int(a - begins[d]) + done, stream[a:b], total, self.sequence + w, int(a - heads[w])
        self.sequence += len(cuts)
        rest = [d for d in range(len(ends)) if ends[d] > last]
        self.docs = [(self.docs[d][0], self.docs[d][1], self.docs[d][2] + max(0, int(last - begins[d]))) for d in rest]
        self.ids = [stream[max(last, begins[d]) : ends[d]] for d in rest]


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Pieces of the documents of df: key, start, length, ids (or ids_crc32), doc_tokens, sequence_id, offset."""
    importable(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        packer = Packer(bpe.sentence, TaskContext.get().partitionId() << 32)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids = [r[2] for r in rows]
            last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digests else pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            cols = [pa.array([r[0] for r in rows], key_arrow), *(pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [len(x) for x in ids])), last, *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        key_arrow = None
        for batch in batches:
            key_arrow = batch.column(0).type
            keys = batch.column(0).to_pylist()
            data, at = utf8(batch.column(1))
            for i, j in blocks(at):
                texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                for k, ids in zip(keys[i:j], bpe.encode(texts), strict=True):
                    packer.add(k, ids)
                if rows := list(packer.flush(final=False)):
                    yield out(rows)
        if rows := list(packer.flush(final=True)):
            yield out(rows)

    names = ["key", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"key {kind}, start bigint, length bigint, " + ("ids_crc32 bigint" if digests else "ids array<int>") + ", doc_tokens bigint, sequence_id bigint, offset bigint"
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack(documents(spark, sf_dir), path or byte_vocabulary(), digests=True).withColumnRenamed("key", "doc_id")

"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match. A sequence of tokens is what the merges
would give if and only if each adjacent pair is, so the pairs of all new words of a block are
tested at once against a table of pairs; pairs not met before are settled by merging the pair's own
symbols. Words with a failing pair, and no others, go through the exact merges.

Words repeat, so each task keeps the ids of the words it has met, up to a bound; beyond it the
words of a block are encoded anew. One scan, no shuffle.

Defined results: a null text counts as empty, and empty texts have no tokens and decode to the
empty text; very long texts are encoded whole; repeated rows each give a row; an empty table gives
no rows; other columns are ignored. A text that holds a special token's own string yields that
token's id, as the tokenizers library has it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, importable
from ._pretoken import BEYOND, joined, pieces
from ._text import BYTE_CODE, U, blocks, mix64, powers, utf8

#: Words whose ids a task keeps.
KEPT_WORDS = 500_000


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class WordBPE:
    """A byte-level BPE with an end-of-word mark, read from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.marks = len(self.end) > 0
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.ranks = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.words = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.of_byte = {c: b for b, c in enumerate(self.alphabet)}
        self.longest = max(len(self._symbols(t)) for t in self.vocab) + 1
        self.size = max(self.names) + 1
        self.pair_key, self.pair_fit = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        self.kept: dict[int, tuple[bytes, str]] = {}
        self.tables = self._tables()

    # --- text to words

    def normalise(self, text: str) -> str:
        # characters are lower-cased one by one: no rule for a final sigma
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """(word, -1), or ("", id) of a special token."""
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                yield "", self.special[piece]
            else:
                for word in self.words.findall(self.normalise(piece)):
                    yield word, -1

    # --- one word

    def _symbols(self, token: str) -> tuple[str, ...]:
        marked = bool(self.end) and token.endswith(self.end)
        chars = list(token[: -len(self.end)] if marked else token)
        if marked and chars:
            chars[-1] += self.end
        return tuple(chars)

    def _tables(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length in symbols (the end mark counts as one): sorted hashes of the tokens, and their ids."""
        by_length: dict[int, list[tuple[int, int]]] = {}
        for token, i in self.vocab.items():
            if self.merged(self._symbols(token)) != [token]:  # merging never gives this token
                continue
            marked = bool(self.end) and token.endswith(self.end) and token != self.end
            raw = bytes(self.of_byte[c] for c in (token[: -len(self.end)] if marked else token)) + b"\xff" * marked
            if b"\xff" in raw[: len(raw) - marked]:
                continue
            with np.errstate(over="ignore"):
                h = np.sum(BYTE_CODE[np.frombuffer(raw, np.uint8)] * powers(len(raw))[0], dtype=U)
            by_length.setdefault(len(raw), []).append((int(h), i))
        out = {}
        for length, pairs in by_length.items():
            pairs.sort()
            out[length] = np.array([p[0] for p in pairs], U), np.array([p[1] for p in pairs], np.int64)
        return out

    def symbols(self, word: bytes) -> tuple[str, ...]:
        chars = [self.alphabet[b] for b in word]
        chars[-1] += self.end
        return tuple(chars)

    def merged(self, symbols: Iterable[str]) -> list[str]:
        """The exact merges: the lowest rank first, the leftmost of equal ones."""
        out, get, never = list(symbols), self.ranks.get, 1 << 60
        ranks = [get(p, never) for p in zip(out, out[1:], strict=False)]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((out[i], out[i + 1]), never)
            if i:
                ranks[i - 1] = get((out[i - 1], out[i]), never)
        return out

    # --- many words

    def _greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Proposed ids of all words in a row, and the word of each: the longest match at each
        place, for all words at once. The end mark counts as one more symbol after a word's bytes."""
        n = np.array([len(w) for w in words], np.int64)
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(n + 1, out=offsets[1:])
        buf = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)  # no UTF-8 byte is 0xFF
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
        at, stop = offsets[:-1].copy(), offsets[1:] if self.end else offsets[1:] - 1
        live, ids, owner = np.arange(len(words)), [], []
        while len(live):
            pos, room = at[live], stop[live] - at[live]
            found = np.full(len(live), -1, np.int64)
            size = np.zeros(len(live), np.int64)
            open_ = np.arange(len(live))
            for length in range(min(self.longest, int(room.max())), 0, -1):
                if (table := self.tables.get(length)) is None:
                    continue
                # the end mark is no symbol of its own: it can't be left over
                pick = open_[(room[open_] >= length) & (room[open_] != length + 1)] if self.marks else open_[room[open_] >= length]
                if not len(pick):
                    continue
                with np.errstate(over="ignore"):
                    h = (sums[pos[pick] + length] - sums[pos[pick]]) * down[pos[pick]]
                i = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
                hit = table[0][i] == h
                found[pick[hit]], size[pick[hit]] = table[1][i[hit]], length
                open_ = open_[found[open_] < 0]
            if len(open_):
                raise ValueError("a byte has no token")
            ids.append(found)
            owner.append(live)
            at[live] += size
            live = live[at[live] < stop[live]]
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def _fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging gives each pair (first * size + second) as it stands. Answers are kept in
        a table of fixed size, in which newer pairs take the places of older ones."""
        with np.errstate(over="ignore"):
            place = (mix64(pairs.astype(U)) & U(len(self.pair_key) - 1)).astype(np.int64)
        new = np.unique(pairs[self.pair_key[place] != pairs])
        fresh = np.zeros(len(new), bool)
        for i, p in enumerate(new.tolist()):
            two = [self.names[p // self.size], self.names[p % self.size]]
            fresh[i] = self.merged([*self._symbols(two[0]), *self._symbols(two[1])]) == two
        known = self.pair_key[place] == pairs
        out = np.where(known, self.pair_fit[place], False)
        if len(new):
            out[~known] = fresh[np.searchsorted(new, pairs[~known])]
            with np.errstate(over="ignore"):
                place = (mix64(new.astype(U)) & U(len(self.pair_key) - 1)).astype(np.int64)
            self.pair_key[place] = new
            # two new pairs may share a place: the one that is there now decides
            self.pair_fit[place] = fresh[np.searchsorted(new, self.pair_key[place])]
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (its UTF-8 bytes, not empty)."""
        if not words:
            return []
        flat, owner = self._greedy(words)
        inner = owner[1:] == owner[:-1]
        fit = self._fits((flat[:-1] * self.size + flat[1:])[inner])
        cut = np.searchsorted(owner, np.arange(len(words) + 1))
        out = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in np.unique(owner[:-1][inner][~fit]).tolist():
            out[i] = np.array([self.vocab[t] for t in self.merged(self.symbols(words[i]))])
        return out

    def learn(self, new: dict[int, bytes]) -> None:
        """Keep ids (as bytes) and decoded form of words by their hash."""
        for (h, _), ids in zip(new.items(), self.encode_words(list(new.values())), strict=True):
            self.kept[h] = (ids.astype("<u4").tobytes(), " ".join([self.names[i] for i in ids.tolist()]))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids, and their decoded text, of each text."""
        out: list = [None] * len(texts)
        plain, clean = [], []
        for i, t in enumerate(texts):
            norm = self.normalise(t)
            if BEYOND.search(norm) or any(s in t for s in self.special):
                parts = list(self.parts(t))
                found = iter(self.encode_words([w.encode("utf-8", "replace") for w, k in parts if k < 0]))
                ids = [next(found) if k < 0 else np.array([k]) for _, k in parts]
                flat = np.concatenate([np.zeros(0, np.int64), *ids])
                out[i] = (flat.astype("<u4"), self.decode(flat))
            else:
                plain.append(i)
                clean.append(norm)
        buf, begin, end, hashes, first = pieces(*joined(clean), blanks=False)
        each, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.kept) + len(each) > KEPT_WORDS:
            self.kept.clear()
        each, kept = each.tolist(), self.kept
        raw = buf.tobytes()
        self.learn({h: raw[begin[k] : end[k]] for h, k in zip(each, one.tolist(), strict=True) if h not in kept})
        rows = [kept[h] for h in each]
        ids, said = [r[0] for r in rows], [r[1] for r in rows]
        back = back.tolist()
        for i, a, b in zip(plain, first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = back[a:b]
            out[i] = (np.frombuffer(b"".join([ids[k] for k in own]), "<u4"), " ".join([said[k] for k in own]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: the tokens' names, joined by blanks; special ones too."""
        return " ".join(self.names[int(i)] for i in ids if int(i) in self.names)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) per row of df; with digests, their lengths and SHA-256 instead."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at):
                texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                done = bpe.encode(texts)
                ids = [x[0] for x in done]
                if digests:
                    cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in done])]
                else:
                    cols = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x[1] for x in done], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], names=names)

    kind = dict(df.dtypes)[key]
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["key", "ids", "decoded"]
    schema = f"key {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document with the vocabulary word_bpe_49k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode_documents(documents(spark, sf_dir), path, digests=True).withColumnRenamed("key", "doc_id")

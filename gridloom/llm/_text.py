"""Vectorised text work on the bytes of Arrow string columns.

A batch is cut into blocks of whole documents of a few MB, so that the arrays here stay
small whatever the batch; a longer document forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n 64-bit constants made from a rule."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 20)) * U(0x9E3779B97F4A7C15))


BYTE_CODE = seeds(256, 7)
BASE = U(int(seeds(1, 11)[0]) | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # an empty table
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes are at most ``most`` together (or a single row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def separated(data: np.ndarray, offsets: np.ndarray, fill: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with one byte ``fill`` before each row and after the last; starts of the rows."""
    lengths = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + np.arange(1, len(lengths) + 1)
    out = np.full(int(offsets[-1] - offsets[0]) + len(lengths) + 1, fill, np.uint8)
    out[np.arange(int(offsets[-1] - offsets[0])) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = data[offsets[0] : offsets[-1]]
    return out, starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, A-Z lower-cased, and each row's first word (one more
    than rows). inside: 256 booleans, the bytes that words are made of; it excludes the blank."""
    buf, starts = separated(data, offsets)
    buf = LOWER[buf]
    word = inside[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
    return hashes, np.searchsorted(begin, np.append(starts, len(buf)))


def byte_set(pattern: str) -> np.ndarray:
    """Booleans of the bytes that a bytes pattern of one character class matches."""
    import re

    made = re.compile(pattern.encode("latin-1"))
    return np.array([bool(made.fullmatch(bytes([i]))) for i in range(256)])


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing; bytes of longer
#: UTF-8 characters are 0x80 and more, so that classes of bytes do what classes of characters do.
NOT_WHITE = byte_set(r"[^\x20\x09-\x0D]")
ALNUM = byte_set(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words the whole
    sequence is one, without words there is none."""
    with np.errstate(over="ignore"):
        n = len(words)
        m = max(n - k + 1, 0)
        rolled = np.full(m, U(k))
        for i in range(k):
            rolled = mix64(rolled * U(0x9E3779B97F4A7C15) + words[i : i + m])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                x = np.array([b - a], U)
                for i in range(a, b):
                    x = mix64(x * U(0x9E3779B97F4A7C15) + words[i])
                yield x
            else:
                yield words[:0]

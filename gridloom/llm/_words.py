"""Words of many texts at once: their places and 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

from ._text import BYTE_CODE, LOWER, U, byte_set, mix64, powers, separated

#: [^\x00-\x40\x5B-\x60\x7B-\x7F]: letters of ASCII and every character beyond it.
LETTERS = byte_set(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buffer, begins, ends, hashes of the words of the rows, and each row's first word (one more than
    rows). inside: the bytes that words are made of, not the blank. lower: A-Z are lower-cased first."""
    buf, starts = separated(data, offsets)
    if lower:
        buf = LOWER[buf]
    word = inside[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
    return buf, begin, end, hashes, np.searchsorted(begin, np.append(starts, len(buf)))


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """Sums from which :func:`range_hashes` takes hashes of runs of words."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, U), np.cumsum(words * powers(len(words) + 1)[0][:-1], dtype=U)))


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the words begin to end (without end); runs of different lengths or salts differ."""
    down = powers(len(sums))[1]
    with np.errstate(over="ignore"):
        return mix64((sums[end] - sums[begin]) * down[begin] + mix64((end - begin).astype(U) * U(0x10001) + np.asarray(salt).astype(U)))

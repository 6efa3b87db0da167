"""Pre-tokenisation of many texts at once, on bytes.

Two public splitting rules are known here by their regular expressions: ``GPT2`` (byte-level BPE;
a blank before a word belongs to it) and ``CLIP`` (white space dropped, digits alone). The arrays
work where every character beyond ASCII is a letter; texts with others are for the caller to
split with the expression itself.
"""

from __future__ import annotations

import numpy as np
import regex

from ._text import BYTE_CODE, U, mix64, powers, separated

GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A character that the arrays can't class: beyond ASCII and no letter, or a control character.
BEYOND = regex.compile(r"[^\p{L}\x09-\x0d\x20-\x7e]")

OTHER, LETTER, DIGIT, BLANK, WHITE, EDGE = range(6)
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[32] = BLANK
CLASS[9:14] = WHITE


def pieces(data: np.ndarray, offsets: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buffer, begins, ends, 64-bit hashes of the pieces, and each row's first piece (one more than rows).

    blanks: the rule GPT2, else CLIP.
    """
    buf, starts = separated(data, offsets)
    kind = CLASS[buf]
    edges = np.append(starts - 1, len(buf) - 1)
    kind[edges] = EDGE
    white = (kind == BLANK) | (kind == WHITE)
    solid = kind <= DIGIT
    before = np.concatenate(([EDGE], kind[:-1])).astype(np.uint8)
    if blanks:
        after_solid = np.append(solid[1:], False)
        white_before = (before == BLANK) | (before == WHITE)
        start = (white & ~white_before) | (white & after_solid) | (solid & (kind != before) & (before != BLANK))
    else:
        start = (solid & ((kind != before) | (kind == DIGIT))) | white
    for q in np.flatnonzero((buf == 39) & start).tolist():
        two = buf[q + 1 : q + 3].tobytes()
        if kind[q] == OTHER and kind[q + 1] == LETTER:
            n = 3 if two in (b"re", b"ve", b"ll") else 2 if two[:1] in (b"s", b"t", b"m", b"d") else 0
            if n:
                start[q + 1] = False
                if solid[q + n]:
                    start[q + n] = True
    start[edges] = True
    at = np.flatnonzero(start)
    begin, end = at[:-1], at[1:]
    keep = ~np.isin(kind[begin], (EDGE,) if blanks else (EDGE, BLANK, WHITE))
    begin, end = begin[keep], end[keep]
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
    return buf, begin, end, hashes, np.searchsorted(begin, np.append(starts, len(buf)))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts in a row, and their offsets."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets

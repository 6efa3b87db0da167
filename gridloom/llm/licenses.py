r"""License scans: fuzzy search for short notices.

A notice of m characters may be found with k errors (inserted, deleted or changed characters). It
is cut into k + 1 parts; k errors can't touch all of them, so every match holds one part exactly
(the pigeonhole principle). Exact search for the parts locates candidate places, and the regex
library's bounded-error matching verifies the edits there and tells the span.

Texts are searched as their words (A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``) joined by
one blank; matches begin and end with words. Besides, ``PHRASES`` are found where their words stand
consecutively; those of 10 characters and more are notices as well ("cc by nc" has no errors to
spare, as one makes "cc by nd" of it). One scan, no shuffle.

Defined results: null and empty texts have no words and no matches; very long texts are searched
whole; repeated rows each give their rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, importable
from ._text import ALNUM, LOWER, blocks, utf8

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices, as words, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2", "apache-2"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
)
#: Errors allowed for each so many characters of a notice.
CHARS_PER_ERROR = 10

_TABLE = bytes(LOWER[i] if ALNUM[LOWER[i]] else 32 for i in range(256))


def words_of(raw: bytes) -> bytes:
    """The words, with one blank between them and around them."""
    return b" " + b" ".join(raw.translate(_TABLE).split()) + b" "


@dataclass(frozen=True)
class Match:
    label: str
    base: bool
    first_word: int
    n_words: int
    errors: int
    likeness: float
    bare: bool = False


class Notice:
    """A notice, its parts and its bounded-error pattern."""

    def __init__(self, words: str, label: str, per_error: int = CHARS_PER_ERROR):
        self.words, self.label, raw = words, label, words.encode()
        self.errors = len(raw) // per_error
        self.bare = words in PHRASES
        edges = np.linspace(0, len(raw), self.errors + 2).astype(int).tolist()
        self.size = len(raw)
        self.parts = [(a, raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.pattern = regex.compile(rb"(?b)(?<= )(?:" + regex.escape(words).replace("\\ ", " ").encode() + b"){e<=%d}(?= )" % self.errors)

    def windows(self, text: bytes) -> set[tuple[int, int]]:
        """Ranges of text around exact parts; each match lies in that of a part it holds."""
        reach, found = self.errors + 1, set()
        for offset, part in self.parts:
            at = text.find(part)
            while at >= 0:
                found.add((max(0, at - offset - reach), min(len(text), at - offset + self.size + reach)))
                at = text.find(part, at + 1)
        return found

    def best(self, text: bytes, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(errors, begin, end, a, b) of the best match in text[a:b], if there is one."""
        m = self.pattern.search(text, a, b) if b - a >= self.size - self.errors else None
        if m:
            yield sum(m.fuzzy_counts), m.start(), m.end(), a, b

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, errors) of the matches in text, which is as words_of() gives it. Of matches
        that overlap the one with fewer errors counts, then the earlier one."""
        heap = [x for a, b in self.windows(text) for x in self.best(text, a, b)]
        heapify(heap)
        taken: list[tuple[int, int, int]] = []
        while heap:
            errors, begin, end, a, b = heappop(heap)
            i = bisect_right(taken, (begin, len(text), 0))
            over = [t for t in taken[max(0, i - 1) : i + 1] if t[0] < end and t[1] > begin]
            if not over:
                taken.insert(i, (begin, end, errors))
                over = [(begin, end, errors)]
            # what is left of the window beside them may hold others
            edges = [a, *(e for t in over for e in t[:2]), b]
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                for x in self.best(text, lo, hi):
                    heappush(heap, x)
        return taken


class Scanner:
    def __init__(self):
        self.notices = [Notice(*n) for n in NOTICES]
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]

    def scan(self, text: bytes) -> list[Match]:
        """All matches in text, which is as words_of() gives it."""
        base, near = [], []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                base.append((at, label, phrase.count(b" ") - 1))
                at = text.find(phrase, at + 1)
        for n in self.notices:
            near += [(a, b, errors, n) for a, b, errors in n.search(text)]
        if not base and not near:
            return []
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)  # counted once, however many matches there are
        before = lambda places: np.searchsorted(blanks, places).tolist()
        out = [Match(label, True, word, n, 0, 1.0) for (_, label, n), word in zip(base, before([x[0] for x in base]), strict=True)]
        for (_, _, errors, n), first, last in zip(near, before([x[0] for x in near]), before([x[1] for x in near]), strict=True):
            out.append(Match(n.label, False, first - 1, last - first + 1, errors, 1.0 - errors / n.size, n.bare))
        return out


def longest(matches: list[Match]) -> list[Match]:
    """matches without those of bare phrases inside another match of their label."""
    wide: dict[str, list[tuple[int, int]]] = {}
    for m in matches:
        if m.base or not m.bare:
            wide.setdefault(m.label, []).append((m.first_word, m.first_word + m.n_words))
    reach = {}
    for label, spans in wide.items():
        spans.sort()
        reach[label] = [s[0] for s in spans], list(accumulate((s[1] for s in spans), max))
    out = []
    for m in matches:
        begin, end = reach.get(m.label, ([], []))
        i = bisect_right(begin, m.first_word)
        if m.base or not m.bare or not i or end[i - 1] < m.first_word + m.n_words:
            out.append(m)
    return out


def _scan_rows(df: DataFrame, key: str, text: str, make, schema: str) -> DataFrame:
    importable(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at):
                raw = data[at[i] : at[j]].tobytes()
                cut = (at[i : j + 1] - at[i]).tolist()
                found = [(words_of(raw[a:b]), raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                index, columns = make([(t, scanner.scan(t), own) for t, own in found])
                keys = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([keys if index is None else keys.take(pa.array(index, pa.int64())), *columns], names=["key", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"key {kind}, {schema}")


_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def find_notices(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each match: key, label, base, first_word, n_words, errors, likeness, and the span
    (begin, end) in code points of the text. A bare phrase isn't told again inside another match
    of its label."""

    def make(rows):
        index, out = [], []
        for i, (_, matches, raw) in enumerate(rows):
            spans = [m.span() for m in _WORD.finditer(raw.decode("utf-8", "replace"))] if matches else []
            for m in longest(matches):
                index.append(i)
                out.append((m, spans[m.first_word][0], spans[m.first_word + m.n_words - 1][1]))
        return index, [pa.array([x[0].label for x in out], pa.string()), pa.array([x[0].base for x in out], pa.bool_()), *(pa.array([getattr(x[0], f) for x in out], pa.int64()) for f in ("first_word", "n_words", "errors")), pa.array([x[0].likeness for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())]

    return _scan_rows(df, key, text, make, "label string, base boolean, first_word bigint, n_words bigint, errors bigint, likeness double, begin bigint, end bigint")


def label_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: counts, places and labels."""

    def make(rows):
        def labels(ms):
            return ",".join(sorted({m.label for m in ms}))

        out = []
        for t, matches, _ in rows:
            base = [m for m in matches if m.base]
            first = [m.first_word for m in base]
            out.append((t.count(b" ") - 1 if len(t) > 2 else 0, len(base), min(first, default=None), max(first, default=None), labels(base), labels(matches), max((m.likeness for m in matches), default=0.0)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return None, [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]

    return _scan_rows(df, key, text, make, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of license notices in every document."""
    return label_documents(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")

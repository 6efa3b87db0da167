r"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers spell the same bytes: A (byte-level BPE, on a blank and the text) and B (sentencepiece,
on the text, to which it adds a blank). The transducer reads their tokens in turn. Its state is the
side that leads and the bytes by which it leads, the residual: a suffix of the leading side's last
token. The side behind brings the next token, which links with the leading token; what is left over
is the new residual, of either side. An empty residual closes a group of A and B tokens. Transitions
are memoised by residual and next token.

*Units.* Before a blank that follows a visible character both tokenizers have a border, so there the
residual is empty. Documents are cut at these blanks, and tokens, groups and links of equal units are
found once for a block and kept by each task, up to a bound. A document goes through the
transducer whole if it has the character U+2581, which B can't tell from a blank, or a unit whose tokens don't spell it.

*Counts.* The scan writes for each document the pairs of ids that it links and how often. Spark sums
them over the corpus, finds each B id's highest count and joins the sums with the documents' pairs;
pairs of ids are sent to all tasks up to ``SENT_PAIRS`` rows, by their measured number, and are
joined by shuffle beyond it.

Defined results: null and empty texts, and texts that the tokens of A or B don't spell, have no tokens:
numbers are 0, the list of groups is empty and its digest ''. Strings of special tokens are plain text.
Very long texts are aligned whole; repeated rows count as documents of their own, and equal or null
keys work like others; ties of counts are all best; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, few_rows, importable, materialise, release
from ._pretoken import BEYOND, pieces
from ._text import BYTE_CODE, U, blocks, mix64, powers, separated, utf8
from .bpe import byte_alphabet
from .packing import KEPT_WORDS, ByteBPE

#: Units that a task keeps; a unit counts once for each UNIT_BYTES bytes.
KEPT_UNITS, UNIT_BYTES = 200_000, 64
#: Transitions that a task keeps.
KEPT_MOVES = 1_000_000
#: Tokens of A up to which units go through the transducer side by side; longer ones go alone.
ABREAST = 512
#: Pairs of ids that are sent to every task.
SENT_PAIRS = 2_000_000
#: B's sign for a blank.
BLANK = "▁"


class Transducer:
    """Groups and links of two sequences of tokens that spell the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.spell = a_bytes, b_bytes
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.number: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.moves: dict[int, int] = {}

    def state(self, side: int, residual: bytes) -> int:
        key = (side, residual) if residual else (0, b"")
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def move(self, state: int, token: int) -> int:
        """The state after the side that is behind (in the empty state: A) brings a token; -1: it doesn't fit."""
        side, residual = self.states[state]
        if not residual:
            new = self.state(0, self.spell[0][token])
        else:
            spelt = self.spell[1 - side][token]
            if residual.startswith(spelt):
                new = self.state(side, residual[len(spelt) :])
            elif spelt.startswith(residual):
                new = self.state(1 - side, spelt[len(residual) :])
            else:
                new = -1
        self.moves[state << 32 | token] = new
        return new

    def run(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
        """(groups, links) of all tokens."""
        if len(self.moves) > KEPT_MOVES:
            self.restart()
        groups, links, get, states = [], [], self.moves.get, self.states
        i = j = from_a = from_b = state = 0
        while i < len(a) or j < len(b) or state:
            if not state:
                token = a[i]
                i += 1
            elif states[state][0]:  # B leads
                token = a[i]
                i += 1
                links.append((token, b[j - 1]))
            else:
                token = b[j]
                j += 1
                links.append((a[i - 1], token))
            new = get(state << 32 | token)
            state = self.move(state, token) if new is None else new
            if state < 0:
                raise ValueError("the tokens spell different bytes")
            if not state:
                groups.append((a[from_a:i], b[from_b:j]))
                from_a, from_b = i, j
        return groups, links

    def abreast(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, ...]:
        """As :meth:`run` for many sequences in a row, all one step at a time: the group of each A and B token
        (numbered within its sequence), and of the links the sequence, A token and B token, in their order."""
        if len(self.moves) > KEPT_MOVES:
            self.restart()
        n = len(a_at) - 1
        i, j, state, group = a_at[:-1].copy(), b_at[:-1].copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        a_group, b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        live = np.flatnonzero(a_at[1:] > a_at[:-1])
        linked = []
        while len(live):
            now = state[live]
            sides = np.fromiter((x[0] for x in self.states), np.int8, len(self.states))
            from_b = (now > 0) & (sides[now] == 0)  # A leads, so B brings a token
            one, two = live[~from_b], live[from_b]
            token = np.empty(len(live), np.int64)
            token[~from_b], token[from_b] = a[i[one]], b[j[two]]
            a_group[i[one]], b_group[j[two]] = group[one], group[two]
            i[one] += 1
            j[two] += 1
            with_link = live[now > 0]
            linked.append((with_link, a[i[with_link] - 1], b[j[with_link] - 1]))
            keys, back = np.unique(now << 32 | token, return_inverse=True)
            get, move = self.moves.get, self.move
            moved = [move(k >> 32, k & 0xFFFFFFFF) if (v := get(k)) is None else v for k in keys.tolist()]
            if min(moved) < 0:
                raise ValueError("the tokens spell different bytes")
            state[live] = np.array(moved, np.int64)[back]
            group[live] += state[live] == 0
            live = live[(state[live] > 0) | (i[live] < a_at[live + 1])]
        owner, left, right = (np.concatenate([x[k] for x in linked]) if linked else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(owner, kind="stable")
        return a_group, b_group, owner[order], left[order], right[order]


def spelt(groups: list[tuple[list[int], list[int]]]) -> str:
    """a1,a2|b1;a3|b2,b3"""
    return ";".join([",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups])


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences in a row, and where each begins (one more than sequences)."""
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=at[1:])
    return np.fromiter(chain.from_iterable(ids), np.int64, int(at[-1])), at


def _picked(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some sequences of those in a row, and where each begins."""
    n = at[rows + 1] - at[rows]
    to = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(at[rows] - to[:-1], n) + np.arange(int(to[-1]))], to


class PlainBPE(ByteBPE):
    """The byte-level BPE for which strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.full.encode_special_tokens = True

    def flat(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8) in a row, and where each text's begin."""
        whole = b"".join(raws).decode()
        odd = [k for k, r in enumerate(raws) if BEYOND.search(r.decode())] if BEYOND.search(whole) else []
        clean = raws
        if odd:
            clean = list(raws)
            for k in odd:
                clean[k] = b""
        offsets = np.zeros(len(raws) + 1, np.int64)
        np.cumsum([len(r) for r in clean], out=offsets[1:])
        buf, begin, end, hashes, first = pieces(np.frombuffer(b"".join(clean), np.uint8), offsets, blanks=True)
        each, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.kept) + len(each) > KEPT_WORDS:
            self.kept.clear()
        names, kept, raw = each.tolist(), self.kept, buf.tobytes()
        for h, a, b in zip(names, begin[one].tolist(), end[one].tolist(), strict=True):
            if h not in kept:
                kept[h] = self._word(raw[a:b])
        words = [kept[h] for h in names]
        at = np.concatenate(([0], np.cumsum([len(w) // 4 for w in words], dtype=np.int64)))
        ids, to = _picked(np.frombuffer(b"".join(words), "<u4").astype(np.int64), at, back)
        to = to[first]
        if odd:
            own = {k: np.array(self.full.encode(raws[k].decode(), add_special_tokens=False).ids, np.int64) for k in odd}
            parts = [own[k] if k in own else ids[to[k] : to[k + 1]] for k in range(len(raws))]
            ids, to = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, to


class Aligned:
    """Rows of aligned texts or units: whether tokens spell them, numbers of A's and B's tokens and of groups,
    the groups as text, and the codes of the links, row after row."""

    def __init__(self):
        self.fits, self.numbers, self.said = np.zeros(0, bool), np.zeros((0, 3), np.int64), []
        self.links, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, other: "Aligned") -> None:
        self.fits, self.numbers = np.concatenate((self.fits, other.fits)), np.concatenate((self.numbers, other.numbers))
        self.said += other.said
        self.at = np.concatenate((self.at, self.at[-1] + other.at[1:]))
        self.links = np.concatenate((self.links, other.links))

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of rows, one after another, and how many each has."""
        codes, to = _picked(self.links, self.at, rows)
        return codes, np.diff(to)


class Aligner:
    """Both tokenizers, the transducer, and the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = PlainBPE(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_byte = {c: i for i, c in enumerate(byte_alphabet())}
        names = {i: t for t, i in self.a.full.get_vocab(with_added_tokens=True).items()}
        a_bytes = [bytes(of_byte[c] for c in names[i]) if all(c in of_byte for c in names.get(i, "")) else b"" for i in range(max(names) + 1)]
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        plain = [not (b.is_control(i) or b.is_unknown(i) or b.is_byte(i)) for i in range(len(pieces))]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.spell = a_bytes, b_bytes
        self.length = tuple(np.array([len(x) for x in spell]) for spell in self.spell)
        #: an id as it stands in the text of a group: before a token of its side, at the end of its side
        self.shown = tuple((np.array([f"{i}," for i in range(len(spell))], object), np.array([f"{i}{end}" for i in range(len(spell))], object)) for spell, end in zip(self.spell, "|;", strict=True))
        #: no piece of B has a blank after another character, so that a blank begins a piece
        self.cut = not any(p.lstrip(BLANK).find(BLANK) >= 0 for p, k in zip(pieces, plain, strict=True) if k)
        self.width = len(b_bytes)
        self.transducer = Transducer(a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.kept, self.room = Aligned(), KEPT_UNITS

    def _spelling(self, raws: list[bytes], side: int, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the ids of each text spell it."""
        sizes = np.array([len(r) for r in raws])
        sums = np.concatenate(([0], np.cumsum(self.length[side][ids])))
        fits = sums[at[1:]] - sums[at[:-1]] == sizes
        spell = self.spell[side]
        own = np.flatnonzero(fits)
        # of texts of the right length all bytes are compared in a row
        keep = np.repeat(fits, np.diff(at))
        said = np.frombuffer(b"".join([spell[i] for i in ids[keep].tolist()]), np.uint8)
        want = np.frombuffer(b"".join([raws[k] for k in own.tolist()]), np.uint8)
        ends = np.cumsum(sizes[own])
        fits[own[np.unique(np.searchsorted(ends, np.flatnonzero(said != want), "right"))]] = False
        return fits

    def aligned(self, texts: list[str]) -> Aligned:
        """Each text, with the blank that both sides have before it."""
        out = Aligned()
        if not texts:
            return out
        raws = [b" " + t.encode("utf-8", "replace") for t in texts]
        flat = self.a.flat(raws), _flat(self.b.encode(texts, num_threads=1))
        fits = self._spelling(raws, 0, *flat[0]) & self._spelling(raws, 1, *flat[1])
        many = np.diff(flat[0][1]) > ABREAST
        out.fits, out.numbers = fits, np.zeros((len(texts), 3), np.int64)
        said, codes, count = [""] * len(texts), [], np.zeros(len(texts), np.int64)
        short = np.flatnonzero(fits & ~many)
        (a, a_at), (b, b_at) = (_picked(*x, short) for x in flat)
        a_group, b_group, owner, left, right = self.transducer.abreast(a, a_at, b, b_at)
        # tokens in the order of their groups, A's first
        a_own, b_own = (np.repeat(np.arange(len(short)), np.diff(x)) for x in (a_at, b_at))
        place = np.concatenate(((a_own << 32 | a_group) * 2, (b_own << 32 | b_group) * 2 + 1))
        order = np.argsort(place, kind="stable")
        last = np.append(place[order][1:] != place[order][:-1], True)[np.argsort(order, kind="stable")]
        words = np.concatenate([np.where(end, shown[1][x], shown[0][x]) for x, shown, end in ((a, self.shown[0], last[: len(a)]), (b, self.shown[1], last[len(a) :]))])[order].tolist()
        cuts = np.concatenate(([0], np.cumsum(np.diff(a_at) + np.diff(b_at)))).tolist()
        for k, (x, y) in zip(short.tolist(), zip(cuts, cuts[1:], strict=False), strict=True):
            said[k] = "".join(words[x:y])[:-1]
        groups = np.zeros(len(short), np.int64)
        np.maximum.at(groups, a_own, a_group + 1)
        out.numbers[short] = np.column_stack((np.diff(a_at), np.diff(b_at), groups))
        count[short] = np.bincount(owner, minlength=len(short))
        ends = np.cumsum(np.bincount(owner, minlength=len(short)))
        pairs = left * self.width + right
        long = {}
        for k in np.flatnonzero(fits & many).tolist():
            one, two = (x[at[k] : at[k + 1]].tolist() for x, at in flat)
            found, links = self.transducer.run(one, two)
            out.numbers[k] = len(one), len(two), len(found)
            said[k] = spelt(found)
            long[k] = np.array(links, np.int64) @ np.array([self.width, 1])
            count[k] = len(links)
        if long:  # rows of both kinds in their order
            parts = dict(zip(short.tolist(), np.split(pairs, ends[:-1]) if len(short) else [], strict=True)) | long
            codes = [parts[k] for k in sorted(parts)]
            pairs = np.concatenate(codes)
        out.said, out.links = said, pairs
        out.at = np.concatenate(([0], np.cumsum(count)))
        return out

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row in ``kept`` of each unit of a block of texts, in order, and each text's first (one more than
        texts); units not met before are aligned. An empty text has a unit that doesn't fit."""
        buf, starts = separated(data, offsets)  # a blank before each text, as both sides have it
        n = len(buf) - 1
        before = np.concatenate(([32], buf[:n])).astype(np.uint8)[:n]
        lead = np.concatenate(([32, 32], buf[: max(n - 1, 0)])).astype(np.uint8)[:n]
        # a visible ASCII character, or one of two bytes from U+00C0 on: no white space
        visible = ((before > 32) & (before < 127)) | ((before >= 128) & (before < 192) & (lead >= 0xC3) & (lead <= 0xDF))
        start = (buf[:n] == 32) & visible & self.cut
        start[starts - 1] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        up, down = powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(buf) + 1, U)
            np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
            hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
        each, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        cost = 1 + (end - begin)[one] // UNIT_BYTES
        names = each.tolist()
        new = np.flatnonzero([h not in self.row for h in names])
        if cost[new].sum() > self.room:
            self.forget()
            new = np.arange(len(names))
        raw = buf.tobytes()
        texts = [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(begin[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
        found = self.aligned(texts)
        found.fits &= np.array([t != "" for t in texts], bool)
        first = len(self.row)
        self.row.update((names[k], first + i) for i, k in enumerate(new.tolist()))
        self.kept.add(found)
        self.room -= int(cost[new].sum())
        rows = np.array([self.row[h] for h in names], np.int64)
        return rows[back], np.searchsorted(begin, np.append(starts - 1, n))

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of a block of texts: numbers (of A's and B's tokens, groups, links) and groups as text of each, and of all links
        the text and the code. Zeros where there are no tokens."""
        rows, first = self.units(data, offsets)
        n, mark = len(first) - 1, BLANK.encode()
        raw = data[offsets[0] : offsets[-1]].tobytes()
        sizes = np.diff(offsets)
        fit = np.add.reduceat(np.append(~self.kept.fits[rows], False).astype(np.int64), first[:-1]) == 0 if n else np.zeros(0, bool)
        if mark in raw:
            cut = (offsets - offsets[0]).tolist()
            fit &= np.array([mark not in raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], bool)
        whole = np.flatnonzero(~fit & (sizes > 0))
        alone = self.aligned([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in whole.tolist()])
        take = np.repeat(fit, np.diff(first))
        owner = np.repeat(np.arange(n), np.diff(first))[take]
        codes, count = self.kept.codes(rows[take])
        numbers = np.zeros((n, 4), np.int64)
        np.add.at(numbers, owner, np.column_stack((self.kept.numbers[rows[take]], count)))
        own_codes, own_count = alone.codes(np.flatnonzero(alone.fits))
        numbers[whole[alone.fits]] = np.column_stack((alone.numbers[alone.fits], own_count))
        said = [""] * n
        names, at = self.kept.said, first.tolist()
        units = rows.tolist()
        for k in np.flatnonzero(fit).tolist():
            said[k] = ";".join([names[u] for u in units[at[k] : at[k + 1]]])
        for k, ok, x in zip(whole.tolist(), alone.fits.tolist(), alone.said, strict=True):
            said[k] = x if ok else ""
        text = np.concatenate((np.repeat(owner, count), np.repeat(whole[alone.fits], own_count)))
        return numbers, said, text, np.concatenate((codes, own_codes))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """A row for each text of a block: numbers of A's and B's tokens and of groups, groups as text, codes of the links."""
        numbers, said, text, codes = self.block(data, offsets)
        order = np.argsort(text, kind="stable")
        parts = np.split(codes[order], np.cumsum(numbers[:, 3])[:-1]) if len(said) else []
        for n, x, links in zip(numbers.tolist(), said, parts, strict=True):
            yield *n[:3], x, links


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _scanned(df: DataFrame, path_a: str, path_b: str, key: str, text: str, digest: bool) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, times) per row of df."""
    ids = pa.list_(pa.int32())
    group = pa.list_(pa.struct([("a", ids), ("b", ids)]))

    def listed(x: str) -> list[dict]:
        return [dict(zip("ab", ([int(t) for t in side.split(",")] for side in g.split("|")), strict=True)) for g in x.split(";") if g]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at):
                n, said, row, codes = both.block(data[at[i] : at[j]], at[i : j + 1] - at[i])
                said = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said] if digest else list(map(listed, said))
                each, times = np.unique((row << 40) | codes, return_counts=True)
                cuts = pa.array(np.searchsorted(each >> 40, np.arange(j - i + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (each & ((1 << 40) - 1), times.astype(np.int32)))
                cols = [batch.column(0).slice(i, j - i), *(pa.array(np.ascontiguousarray(n[:, k])) for k in range(4)), pa.array(said, pa.string() if digest else group), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    said = "string" if digest else "array<struct<a:array<int>,b:array<int>>>"
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"key {dict(df.dtypes)[key]}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups {said}, pairs array<bigint>, times array<int>")


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) of links (pair, times): best if no pair of the same B id has more. pair: A's id * width + B's id."""
    counts = materialise(links.groupBy("pair").agg(F.sum("times").alias("count")), "counts")
    highest = materialise(counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most")), "highest")
    # a row for each id of B's vocabulary at most
    both = counts.join(F.broadcast(highest), F.col("pair") % width == F.col("b"))
    out = materialise(both.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    release(counts)
    release(highest)
    return out


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False, sent: int = SENT_PAIRS) -> DataFrame:
    """A row per row of df: key, n_a, n_b, n_groups, n_links, groups (or, with digest, their SHA-256),
    n_best (links whose pair of ids is its B id's most frequent) and count_sum (of the links' counts)."""
    import sentencepiece

    importable(df.sparkSession)
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = _scanned(df, path_a, path_b, key, text, digest).withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows, "aligned")
    links = rows.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
    pairs = pair_counts(links, width)
    known = F.broadcast(pairs) if few_rows(pairs, sent) else pairs
    each = links.join(known, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(each, "uid", "left").select("key", "n_a", "n_b", "n_groups", "n_links", "groups", zero("n_best"), zero("count_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Every document with byte_bpe_50k.json as A and piece_bpe_32k.model as B."""
    import public_tokenizers

    out = align(documents(spark, sf_dir), path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnsRenamed({"key": "doc_id", "groups": "groups_sha256"})

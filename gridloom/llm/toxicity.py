r"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``) comes in twice: as a vector of its
own, if training knows it, and as the mean of the vectors of its character trigrams. Two gated
recurrent networks read a text forwards and backwards; attention weighs the states of a window of
``WINDOW`` words; a logistic unit scores the window. All overlapping windows of a text, one at each
word, are scored, and the highest score is the text's.

A state is shared by all windows that hold its word. Texts are read in segments of ``SEGMENT``
words; each network starts ``LEAD`` words outside of it, so that every state has read LEAD words and
more on either side, or up to the end of the text. Windows take weighted means of states by sums of
a doubling width. The cost is thus linear in the words, with every window scored, and the score is a
function of the text alone; long texts are segments like short ones.

Labels say which texts are toxic, not which windows, so each round of training takes a text's
highest window of late and, of clean texts, one at random and one that repeats a single word of
theirs. Either input of a word is left out at random, so that both learn. Word vectors start from
smoothed log-odds.

Training reads at most ``SAMPLE`` labelled rows of toxic texts and twice as many of clean ones, those
with the least hash of the id, so its cost is bounded; it runs in one task and is the same for the
same rows. Scoring is one scan without a shuffle; the network (some MB) goes to all tasks.

Defined results: null texts and texts without words have score 0; a text under WINDOW words is one
window; very long texts are scored whole; repeated rows each get a row and equal texts equal scores
(up to rounding, as other rows of a block may lengthen its arrays); null keys work like others; an
empty table gives no rows; without labels of both classes all scores are 0; other columns, whatever
their names, are ignored by :func:`score_documents` and pass through :func:`drop_toxic`.
"""

from __future__ import annotations

import multiprocessing
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, importable
from ._pretoken import joined
from ._text import ALNUM, BYTE_CODE, LOWER, U, blocks, mix64, powers, separated, utf8

WINDOW = 32
#: Words whose states are kept of one run, and words read before and after them.
SEGMENT, LEAD = 112, 8
#: Labelled rows of each class that training reads at most.
SAMPLE = 600
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 12, 12, 8
TRIGRAMS = 1 << 13
#: Rounds of training at least, and steps in all at least; windows are scored anew every RESCORE rounds.
ROUNDS, STEPS, BATCH, RESCORE = 12, 500, 64, 4
#: Shares of words whose own vector, or trigrams, training leaves out; share of windows that repeat a word.
DROP_WORD, DROP_CHARS, REPEATED = 0.1, 0.1, 0.15
#: Standard errors by which a word's log-odds must differ from 0 for it to get a vector.
KNOWN = 2.8


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct words' hashes, each row's words as places in them, and each distinct word's trigrams
    (flat ids and cuts)."""
    data, at = joined(texts)
    buf, starts = separated(data, at)
    buf = LOWER[buf]
    word = ALNUM[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum(BYTE_CODE[buf] * up[:-1], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
        each, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        b, e = begin[one] - 1, np.minimum(end[one] + 1, len(buf))  # with the blanks around it
        n = np.maximum(e - b - 2, 1)
        cuts = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat(b, n) + np.arange(int(cuts[-1])) - np.repeat(cuts[:-1], n)
        # what stands next to a word is a blank to its trigrams
        lone = np.where(word, BYTE_CODE[buf], BYTE_CODE[32])
        tri = mix64(lone[flat] + lone[flat + 1] * U(31) + lone[np.minimum(flat + 2, len(buf) - 1)] * U(961))
    first = np.searchsorted(begin, np.append(starts, len(buf)))
    return each, [back[x:y] for x, y in zip(first[:-1], first[1:], strict=True)], [(tri & U(TRIGRAMS - 1)).astype(np.int64), cuts]


def windows(n: int) -> np.ndarray:
    """Starts of all windows of a text of n words; a shorter text is one window."""
    return np.arange(max(1, n - WINDOW + 1)) if n else np.zeros(0, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p, and their use. State arrays are (step, window, unit)."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary  # sorted hashes; place 0 of the vectors is for other words
        inputs = WORD_DIM + CHAR_DIM
        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.05), "tri": normal(TRIGRAMS, CHAR_DIM, scale=0.05), "wa": normal(2 * HIDDEN, ATTENTION, scale=0.3), "va": normal(ATTENTION, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.p["word"][1:, 0] = odds
        for d in "fb":
            self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"] = normal(inputs, 3 * HIDDEN, scale=0.3), normal(HIDDEN, 3 * HIDDEN, scale=0.2), np.zeros(3 * HIDDEN, np.float32)

    def vectors(self, each: np.ndarray, tri: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of distinct words, and their places in the vocabulary."""
        flat, cuts = tri
        i = np.searchsorted(self.vocabulary, each)
        known = np.append(self.vocabulary, U(0))[i] == each if len(self.vocabulary) else np.zeros(len(each), bool)
        place = np.where(known & (i < len(self.vocabulary)), i + 1, 0)
        n = np.diff(cuts)
        chars = np.add.reduceat(self.p["tri"][flat], cuts[:-1], axis=0) / n[:, None] if len(each) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate((self.p["word"][place], chars), axis=1).astype(np.float32), place

    def run(self, d: str, drive: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States of direction d. drive: (word, 3 * HIDDEN) inputs of the gates; at: (step, window) words."""
        steps, size = at.shape
        wh, h, n2 = self.p[f"h{d}"], np.zeros((size, HIDDEN), np.float32), 2 * HIDDEN
        out, held = np.empty((steps, size, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, g = drive[at[t]], h @ wh
            zr = sigmoid(x[:, :n2] + g[:, :n2])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, n2:] + r * g[:, n2:])
            new = c + z * (h - c)
            if mask is not None:
                new = h + mask[t][:, None] * (new - h)
            if keep:
                held.append((t, h, z, r, c, g[:, n2:]))
            h = out[t] = new
        return out, held

    def logits(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray | None, pool: np.ndarray | None = None) -> np.ndarray:
        """Scores before the logistic unit, a window each; pool: the steps that it holds, if not all of mask."""
        p = self.p
        s = np.concatenate([self.run(d, x @ p[f"x{d}"] + p[f"c{d}"], at, mask)[0] for d in "fb"], axis=2)
        e = np.tanh(s @ p["wa"]) @ p["va"]
        pool = mask if pool is None else pool
        if pool is not None:
            e = np.where(pool > 0, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        return np.einsum("tb,tbh->bh", a, s) @ p["out"] + p["b"][0]

    def gradients(self, x: np.ndarray, place: np.ndarray, tri: list[np.ndarray], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray, pool: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the weighted mean of the logistic losses of the windows; part: which inputs count; pool: as in logits."""
        x = x * part
        p = self.p
        both = [self.run(d, x @ p[f"x{d}"] + p[f"c{d}"], at, mask, keep=True) for d in "fb"]
        s = np.concatenate([b[0] for b in both], axis=2)
        u = np.tanh(s @ p["wa"])
        e = np.where((mask if pool is None else pool) > 0, u @ p["va"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        ctx = np.einsum("tb,tbh->bh", a, s)
        dl = ((sigmoid(ctx @ p["out"] + p["b"][0]) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": ctx.T @ dl, "b": np.array([dl.sum()], np.float32)}
        dctx = dl[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dctx, s)
        ds = a[:, :, None] * dctx
        de = a * (da - (a * da).sum(axis=0))
        g["va"] = np.einsum("tb,tbk->k", de, u)
        du = de[:, :, None] * p["va"] * (1 - u * u)
        g["wa"] = np.einsum("tbh,tbk->hk", s, du)
        ds += du @ p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            wh, dh = p[f"h{d}"], np.zeros((at.shape[1], HIDDEN), np.float32)
            gwh, driven = np.zeros_like(wh), np.zeros((*at.shape, 3 * HIDDEN), x.dtype)
            for t, h, z, r, c, q in reversed(both[k][1]):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[t][:, None]
                dn, rest = dh * m, dh * (1 - m)
                dz = dn * (h - c) * z * (1 - z)
                dc = dn * (1 - z) * (1 - c * c)
                dr = dc * q * r * (1 - r)
                driven[t, :, :HIDDEN], driven[t, :, HIDDEN : 2 * HIDDEN], driven[t, :, 2 * HIDDEN :] = dz, dr, dc
                inner = np.concatenate((dz, dr, dc * r), axis=1)
                gwh += h.T @ inner
                dh = rest + dn * z + inner @ wh.T
            ddrive = added(at.reshape(-1), driven.reshape(-1, 3 * HIDDEN), len(x))
            g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = gwh, x.T @ ddrive, ddrive.sum(axis=0)
            dx += ddrive @ p[f"x{d}"].T
        dx *= part
        g["word"] = added(place, dx[:, :WORD_DIM], len(p["word"]))
        g["word"][0] = 0
        n = np.diff(tri[1])
        g["tri"] = added(tri[0], np.repeat(dx[:, WORD_DIM:] / n[:, None], n, axis=0), len(p["tri"]))
        return g

    def states(self, x: np.ndarray, rows: list[np.ndarray], batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Attention weight and score of each word's state, rows one after another."""
        p = self.p
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        size = np.array([len(r) for r in rows], np.int64)
        weight, value = np.empty(len(flat), np.float32), np.empty(len(flat), np.float32)
        count = -(-size // SEGMENT)
        row = np.repeat(np.arange(len(rows)), count)
        base = (np.cumsum(size) - size)[row]
        first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        last = np.minimum(first + SEGMENT, size[row])
        begin, end = np.maximum(first - LEAD, 0), np.minimum(last + LEAD, size[row])
        drives = {d: x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}
        order = np.argsort(end - begin, kind="stable")  # runs alike in length together: fewer steps, rarely a mask
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            at, mask = gather(flat, base[k] + begin[k], end[k] - begin[k])
            s = np.concatenate([self.run(d, drives[d], at, None if mask.all() else mask)[0] for d in "fb"], axis=2)
            step = np.arange(len(at))[:, None]
            own = (step >= first[k] - begin[k]) & (step < last[k] - begin[k])
            place = (base[k] + begin[k] + step)[own]
            s = s[own]
            weight[place] = np.exp(np.tanh(s @ p["wa"]) @ p["va"])
            value[place] = s @ p["out"]
        return weight, value

    def window_logits(self, x: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, row and start of all windows of the rows."""
        starts = [windows(len(r)) for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
        start = np.concatenate([np.zeros(0, np.int64), *starts])
        weight, value = self.states(x, rows)
        # rows that are short of a window get words without weight
        size = np.array([len(r) for r in rows], np.int64)
        room = np.maximum(size, WINDOW)
        base = np.cumsum(room) - room
        place = np.arange(len(weight)) + np.repeat(base - (np.cumsum(size) - size), size)
        sums = np.zeros((2, int(room.sum())))
        sums[0, place], sums[1, place] = weight, weight.astype(np.float64) * value
        out = np.zeros_like(sums[:, : max(0, sums.shape[1] - WINDOW + 1)])
        done, width = 0, 1
        while done < WINDOW:  # sums of 1, 2, 4, ... words, as the bits of WINDOW need them
            if WINDOW & width:
                out += sums[:, done : done + out.shape[1]]
                done += width
            sums = sums[:, :-width] + sums[:, width:]
            width *= 2
        at = base[row] + start
        return (out[1, at] / out[0, at] + self.p["b"][0]).astype(np.float32), row, start

    def score(self, texts: list[str]) -> np.ndarray:
        """Score of each text, 0 to 1."""
        each, rows, tri = split_words(texts)
        x, _ = self.vectors(each, tri)
        logit, row, _ = self.window_logits(x, rows)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row, logit)
        return np.where(np.isfinite(best), sigmoid(np.clip(best, -30, 30).astype(np.float64)), 0.0)


def added(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """size rows: the sums of the values at each place."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    order = np.argsort(place, kind="stable")
    own = place[order]
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
    if len(cut):
        out[own[cut]] = np.add.reduceat(values[order], cut, axis=0)
    return out


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, window) words from flat, and a mask of the steps that windows have."""
    step = np.arange(int(length.max()))[:, None]
    mask = (step < length).astype(np.float32)
    return flat[np.minimum(begin + step, begin + length - 1)], mask


def around(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, window) words of windows and LEAD words on either side, of rows from begin to end of
    flat; masks of the steps that there are, and of those in the window."""
    step = np.arange(-LEAD, WINDOW + LEAD)[:, None]
    at = begin + start + step
    there = (at >= begin) & (at < end)
    pool = there & (step >= 0) & (step < WINDOW)
    return flat[np.clip(at, begin, end - 1)], there.astype(np.float32), pool.astype(np.float32)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 5) -> Network | None:
    """A network for texts with labels 0 and 1; None unless there are both."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    each, rows, tri = split_words(texts)
    # texts of each class that hold a word
    have = np.zeros((2, len(each)))
    for r, t in zip(rows, labels, strict=True):
        have[t, np.unique(r)] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)[:, None]
    odds = np.log((have[1] + 0.5) / (total[1] + 1)) - np.log((have[0] + 0.5) / (total[0] + 1))
    # words whose share differs by more than chance get a vector; the trigrams speak for the others
    known = np.flatnonzero(np.abs(odds) >= KNOWN * np.sqrt(1 / (have[1] + 0.5) + 1 / (have[0] + 0.5)))
    net = Network(each[known], (np.clip(odds[known], -4, 4) * 0.25).astype(np.float32), seed)
    weight_of = len(y) / (2 * total[:, 0])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    base = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step = 0
    clean = np.flatnonzero((have[0] > 0) & (have[1] <= have[0]))
    rounds = max(rounds, -(-STEPS * BATCH // (2 * len(y))))
    for n in range(rounds):
        if n % RESCORE == 0:
            x, place = net.vectors(each, tri)
            logit, row, start = net.window_logits(x, rows)
        if n == 0:  # before training the window with the words of the highest odds
            gain = np.concatenate((np.zeros(1), net.p["word"][1:, 0]))[place]
            sums = np.concatenate(([0.0], np.cumsum(np.maximum(gain[flat] - 0.2, 0))))
            logit = sums[np.minimum(base[row] + start + WINDOW, base[row + 1])] - sums[base[row] + start]
        order = np.lexsort((logit, row))
        top = order[np.append(row[order][1:] != row[order][:-1], True)]
        any_ = rng.permutation(len(row))
        any_ = any_[np.unique(row[any_], return_index=True)[1]]
        any_ = any_[y[row[any_]] == 0]  # a random window of a toxic text may well be clean
        pick = rng.permutation(np.concatenate((top, any_)))
        rate_now = 0.01 if n < rounds * 2 // 3 else 0.003
        for i in range(0, len(pick), BATCH):
            k = pick[i : i + BATCH]
            at, mask, pool = around(flat, base[row[k]], base[row[k] + 1], start[k])
            target = y[row[k]]
            if len(clean):
                again = rng.choice(clean, max(1, int(len(k) * REPEATED)))
                at = np.concatenate((at, np.broadcast_to(again, (len(at), len(again)))), axis=1)
                mask = np.concatenate((mask, np.ones((len(mask), len(again)), np.float32)), axis=1)
                pool = np.concatenate((pool, np.ones((len(mask), len(again)), np.float32)), axis=1)
                target = np.concatenate((target, np.zeros(len(again), np.float32)))
            own, inner = np.unique(at, return_inverse=True)  # the batch's words alone
            sub = [np.concatenate([tri[0][tri[1][w] : tri[1][w + 1]] for w in own]), np.concatenate(([0], np.cumsum(np.diff(tri[1])[own])))]
            xs, ps = net.vectors(each[own], sub)
            part = np.concatenate([np.repeat((rng.random((len(own), 1)) >= d).astype(np.float32), n, axis=1) for d, n in ((DROP_WORD, WORD_DIM), (DROP_CHARS, CHAR_DIM))], axis=1)
            g = net.gradients(xs, ps, sub, inner.reshape(at.shape), mask, target, weight_of[target.astype(int)], part, pool)
            step += 1
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.99 * v[name] + 0.01 * grad * grad
                net.p[name] -= (rate_now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            net.p["word"][0] = 0
    return net


def fold(key: str = "doc_id"):
    """The fold of an id: crc32 of the id as text, modulo 5. Fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Network | None:
    """The network for docs, from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(fold(key) != 0).where(F.col(label).isin(0, 1)).select(F.col(key).alias("_gl_key"), F.col(label).cast("int").alias("_gl_label"))
    some = None
    for value, most in ((0, 2 * sample), (1, sample)):
        part = known.where(F.col("_gl_label") == value).orderBy(F.xxhash64("_gl_key"), "_gl_key").limit(most)
        some = part if some is None else some.unionByName(part)
    # at most 3 * sample rows
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), F.col("key") == F.col("_gl_key")).groupBy("key").agg(F.min("text").alias("text"), F.min("_gl_label").alias("label"))
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.to_pydict() for b in batches]
        with multiprocessing.get_context("fork").Pool(1) as child:  # its memory goes with it, the worker's would stay for later stages
            net = child.apply(train, ([t or "" for p in parts for t in p["text"]], [x for p in parts for x in p["label"]]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # learnt in a task: what training takes stays out of the driver's memory
    made = rows.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key").select("text", "label").mapInArrow(run, "net binary").collect()
    return pickle.loads(made[0].net) if made else None


def score_documents(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row of docs."""
    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in blocks(at, 1 << 20):
                texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                scores = net.score(texts) if net else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64())], names=["key", "score"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"key {kind}, score double")


def drop_toxic(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs without the rows whose score is 0.5 or more; same columns."""
    importable(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(place))
            for i, j in blocks(at, 1 << 20):
                texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                yield batch.slice(i, j - i).filter(pa.array(net.score(texts) < 0.5 if net else np.ones(j - i, bool)))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = documents(spark, sf_dir)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, net).select(F.col("key").alias("doc_id"), (fold("key") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0



"""Forests of k-d trees over a distributed base, searched best bin first.

*Index.* The top of each tree is learned on a sample of at most ``SAMPLE`` rows: a cell is halved along
a component drawn from the ``VARIED`` of greatest variance, at its median or mean, until there are as
many cells as asked for (``MOST_CELLS`` at most, so that the top is small whatever the base). Every row is dealt to
its cell of each tree; a cell's rows lie in blocks of ``BLOCK`` rows at most, and a block is a row of the index,
with a tree of its own: vectors in the order of its leaves of ``LEAF`` rows, and the leaves' boxes.

*Search.* Cells are bins, their boxes bound the distance from below. Each round puts the next bins of
each query into a queue of (query, tree, cell, bound), best first, as long as their bound is no
more than the distance of the query's k-th row so far, and joins the queue with the blocks; in a
block only leaves within that distance are looked at. Without a limit on comparisons the answer is exact,
as every bin not visited is too far; with a limit a query stops at the bin that exceeds it.

Rows whose vector is null or of another length aren't indexed. Ties of distance go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tasks import importable, lists, matrix
from .cluster import cut_lineage

#: Rows from which the tops of the trees are learned, at most.
SAMPLE = 100_000
#: Components among which a split is drawn; cells of a tree at most.
VARIED, MOST_CELLS = 5, 4096
#: Rows of a block and of a leaf of its tree, at most; queries that meet a block at a time.
BLOCK, LEAF, QUERIES = 4096, 32, 512


@dataclass(frozen=True)
class Top:
    """The top of a tree: for each node component, threshold, left child (the right one is next to
    it) or 0, and the cell of a leaf."""

    component: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    cell: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.child[at] > 0)
        while len(live):
            k = at[live]
            at[live] = self.child[k] + (x[live, self.component[k]] > self.threshold[k])
            live = live[self.child[at[live]] > 0]
        return self.cell[at]


def grow(x: np.ndarray, cells: int, method: str, rng: np.random.Generator, varied: int = VARIED) -> Top:
    """A tree over the rows of x with so many leaves, if the rows can be told apart; the largest leaf is halved next."""
    nodes = [[0, 0.0, 0]]
    parts = {0: np.arange(len(x))}
    stuck: set[int] = set()
    while len(parts) < cells:
        open_ = [n for n in parts if n not in stuck and len(parts[n]) > 1]
        if not open_:
            break
        node = max(open_, key=lambda n: (len(parts[n]), -n))
        own = x[parts[node]]
        spread = own.var(axis=0)
        first = np.argsort(-spread, kind="stable")[:varied]
        first = first[spread[first] > 0]
        if not len(first):
            stuck.add(node)
            continue
        c = int(rng.choice(first))
        t = float(np.median(own[:, c]) if method == "median" else own[:, c].mean())
        left = own[:, c] <= t
        if left.all():  # the median is the largest value
            t = float(own[own[:, c] < t, c].max())
            left = own[:, c] <= t
        nodes[node] = [c, t, len(nodes)]
        rows = parts.pop(node)
        parts[len(nodes)], parts[len(nodes) + 1] = rows[left], rows[~left]
        nodes += [[0, 0.0, 0], [0, 0.0, 0]]
    cell = np.full(len(nodes), -1)
    cell[sorted(parts)] = np.arange(len(parts))
    return Top(np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]), cell)


@dataclass(frozen=True)
class Index:
    """tops of the trees, boxes and sizes of each tree's cells, and the blocks (tree, cell, n, ids, x,
    ends, low, high): rows in the order of the leaves, where leaves end, and the leaves' boxes."""

    width: int
    tops: tuple[Top, ...]
    low: tuple[np.ndarray, ...]
    high: tuple[np.ndarray, ...]
    sizes: tuple[np.ndarray, ...]
    blocks: DataFrame


def _leaves(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[int]]:
    """An order of the rows of x by halving along the component of largest spread, and ends of the leaves."""
    order, ends, todo = [], [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        own = x[rows]
        if len(rows) <= leaf:
            order.append(rows)
            ends.append((ends[-1] if ends else 0) + len(rows))
            continue
        rows = rows[np.argsort(own[:, own.var(axis=0).argmax()], kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return np.concatenate(order), ends


def build(base: DataFrame, trees: int = 1, cells: int | None = None, method: str = "median", block: int = BLOCK, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 0) -> Index:
    """An index of base (id, x). cells: of each tree; by default one for each ``block`` rows."""
    spark = base.sparkSession
    importable(spark)
    rows = base.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x IS NOT NULL")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("x")).alias("width")).first()
    total, width = stats.n, stats.width or 0
    rows = rows.where(F.size("x") == width)
    cells = min(MOST_CELLS, cells or max(1, -(-total // block)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30))
    part = rows if total <= sample else rows.where(draw < int((1 << 30) * sample * 0.9 / total)).limit(sample)
    found = [r.x for r in part.select("x").collect()]  # at most ``sample`` rows
    found = np.array(found, np.float64).reshape(len(found), width)
    found = found[np.lexsort(found.T[::-1])] if len(found) else found  # whatever order rows came in
    tops = tuple(grow(found, cells, method, np.random.default_rng([seed, t])) for t in range(trees))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            for t, top in enumerate(tops):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(top.cells(x).astype(np.int32)), *batch.columns], names=["tree", "cell", "id", "x"])

    dealt = rows.select("id", "x").mapInArrow(deal, "tree int, cell int, id bigint, x array<double>")
    dealt = cut_lineage(dealt)
    count = dealt.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n"))
    count = count.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    # a row's place among the parts of its cell follows from its id: parts are about of one size
    parted = dealt.join(count.select("tree", "cell", "parts"), ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table["x"].combine_chunks(), width)
        order, ends = _leaves(x, leaf)
        x, starts = x[order], np.array([0, *ends[:-1]])
        low, high = (f.reduceat(x, starts, axis=0) for f in (np.minimum, np.maximum))
        one = lambda v: pa.array([v.reshape(-1)])
        return pa.table({"tree": table["tree"][:1], "cell": table["cell"][:1], "n": pa.array([len(x)], pa.int32()), "ids": pa.array([np.asarray(table["id"])[order]]), "x": one(x), "ends": pa.array([ends], pa.list_(pa.int32())), "low": one(low), "high": one(high)})

    blocks = cut_lineage(parted.groupBy("tree", "cell", "part").applyInArrow(pack, "tree int, cell int, n int, ids array<bigint>, x array<double>, ends array<int>, low array<double>, high array<double>"))
    boxes = _boxes(blocks, width) if total else {}
    low, high, sizes = [], [], []
    for t, top in enumerate(tops):
        n = int(top.cell.max()) + 1
        own = [boxes.get((t, c)) for c in range(n)]
        low.append(np.array([b[0] if b else np.full(width, np.inf) for b in own]).reshape(n, width))
        high.append(np.array([b[1] if b else np.full(width, -np.inf) for b in own]).reshape(n, width))
        sizes.append(np.array([b[2] if b else 0 for b in own], np.int64))
    return Index(width, tops, tuple(low), tuple(high), tuple(sizes), blocks)


def _boxes(blocks: DataFrame, width: int) -> dict:
    """Box and size of each cell, from its blocks' leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.asarray(batch.column(k).slice(i, 1).flatten()).reshape(-1, width) for i in range(batch.num_rows) for k in (3, 4)]
            low, high = np.array([e.min(0) for e in ends[::2]]).reshape(-1, width), np.array([e.max(0) for e in ends[1::2]]).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(low), lists(high)], names=["tree", "cell", "n", "low", "high"])

    each = blocks.select("tree", "cell", "n", "low", "high").mapInArrow(run, "tree int, cell int, n int, low array<double>, high array<double>")
    long = each.select("tree", "cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "z"))
    per = long.groupBy("tree", "cell", "i").agg(F.min("z.low").alias("a"), F.max("z.high").alias("b"), F.sum("n").alias("n"))
    both = per.groupBy("tree", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("s"), F.max("n").alias("n"))
    return {(r.tree, r.cell): ([s.a for s in r.s], [s.b for s in r.s], r.n) for r in both.collect()}


def _gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries from boxes, from below: rounded down by some last digits."""
    out = np.zeros((len(q), len(low)))
    for i in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, i] - q[:, i, None], q[:, i, None] - high[None, :, i]), 0)
        out += gap * gap
    return out * (1 - 1e-12)


def _queue(state: DataFrame, index: Index, take: int | None, limit: int | None) -> DataFrame:
    """(query, q, tree, cell, far) of the bins that each query (query, q, far, seen, used) visits next: the
    first ``take`` ones not seen yet (None: all) no farther than far, as long as the rows compared stay under the limit."""
    low, high, sizes = (np.concatenate(x) for x in (index.low, index.high, index.sizes))
    tree = np.repeat(np.arange(len(index.tops), dtype=np.int32), [len(s) for s in index.sizes])
    cell = np.concatenate([np.arange(len(s), dtype=np.int32) for s in index.sizes])
    width = index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, len(low)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                q = matrix(batch.column(1), width)
                far, seen = np.asarray(batch.column(2)), np.asarray(batch.column(3))
                gap = np.where(sizes > 0, _gaps(q, low, high), np.inf)
                order = np.argsort(gap, axis=1, kind="stable")
                near = np.take_along_axis(gap, order, 1)
                rank = np.arange(len(low))[None, :]
                pick = (rank >= seen[:, None]) & (near <= far[:, None]) & np.isfinite(near)
                if take is not None:
                    pick &= rank < seen[:, None] + take
                if limit is not None:
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    pick &= before < limit
                i, j = np.nonzero(pick)
                at, rows = order[i, j], pa.array(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(tree[at]), pa.array(cell[at]), pa.array(far[i])], names=["query", "q", "tree", "cell", "far"])

    return state.select("query", "q", "far", "seen").mapInArrow(run, "query bigint, q array<double>, tree int, cell int, far double")


def _visited(queue: DataFrame, index: Index, k: int, skip_self: bool, parts: int) -> DataFrame:
    """(query, id, distance, compared): of each query and block the k nearest rows within far, and a row
    without id that says how many rows were compared."""
    width = index.width
    # a bin may be next for all queries: they meet it some hundred at a time
    groups = queue.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(parts))).groupBy("tree", "cell", "g").agg(F.collect_list(F.struct("query", "q", "far")).alias("qs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x, ends = (np.asarray(batch.column(c).slice(r, 1).flatten()) for c in (0, 1, 2))
                low, high = (np.asarray(batch.column(c).slice(r, 1).flatten()).reshape(-1, width) for c in (3, 4))
                x = x.reshape(-1, width)
                qs = batch.column(5).slice(r, 1).flatten()
                names, q, far = np.asarray(qs.field("query")), matrix(qs.field("q"), width), np.array(qs.field("far"))
                gap = _gaps(q, low, high)
                best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
                compared = np.zeros(len(q), np.int64)
                for leaf in np.argsort(gap.min(axis=0), kind="stable"):
                    who = np.flatnonzero(gap[:, leaf] <= far)
                    if not len(who):
                        continue
                    part = slice(ends[leaf - 1] if leaf else 0, ends[leaf])
                    d = ((q[who][:, None, :] - x[None, part, :]) ** 2).sum(axis=2)
                    compared[who] += d.shape[1]
                    own = np.broadcast_to(ids[part], d.shape)
                    if skip_self:
                        d = np.where(own == names[who, None], np.inf, d)
                    d, own = np.concatenate((best_d[who], d), axis=1), np.concatenate((best_i[who], own), axis=1)
                    order = np.lexsort((own, d), axis=1)[:, :k]
                    best_d[who], best_i[who] = np.take_along_axis(d, order, 1), np.take_along_axis(own, order, 1)
                    far[who] = np.minimum(far[who], best_d[who, -1])
                ok = np.isfinite(best_d)
                found = int(ok.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((np.repeat(names, k)[ok.reshape(-1)], names))),
                    pa.array(np.concatenate((best_i[ok], np.zeros(len(q), np.int64))), mask=np.arange(found + len(q)) >= found),
                    pa.array(np.concatenate((best_d[ok], np.zeros(len(q)))), mask=np.arange(found + len(q)) >= found),
                    pa.array(np.concatenate((np.zeros(found, np.int64), compared))),
                ], names=["query", "id", "distance", "compared"])

    both = groups.join(index.blocks, ["tree", "cell"]).select("ids", "x", "ends", "low", "high", "qs")
    return both.mapInArrow(run, "query bigint, id bigint, distance double, compared bigint")


def search(index: Index, queries: DataFrame, k: int, limit: int | None = None, skip_self: bool = False, growth: tuple[int, ...] = (1, 4)) -> DataFrame:
    """(query, id, distance, place, compared): the k nearest rows of each query (id, x) by squared distance.
    limit: of rows of the bins that a query visits, about (None: exact). growth: bins a tree that the first
    rounds visit; the last round visits all bins within the distance of the k-th row."""
    spark = queries.sparkSession
    importable(spark)
    trees = len(index.tops)
    state = cut_lineage(queries.select(F.col("id").cast("bigint").alias("query"), F.col("x").cast("array<double>").alias("q"), F.lit(float("inf")).alias("far"), F.lit(0).alias("seen")))
    parts = max(1, -(-state.count() // QUERIES))
    best = None
    order = Window.partitionBy("query").orderBy("distance", "id")
    for take in (*(g * trees for g in growth), None):
        found = _visited(_queue(state, index, take, limit), index, k, skip_self, parts)
        if best is not None:
            found = found.unionByName(best)
        # trees hold the same rows: a row counts once
        rows = found.where("id IS NOT NULL").groupBy("query", "id").agg(F.min("distance").alias("distance"))
        rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "distance", F.lit(0).cast("long").alias("compared"))
        told = found.where("id IS NULL").groupBy("query").agg(F.sum("compared").alias("compared")).select("query", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("distance"), "compared")
        best = cut_lineage(rows.unionByName(told))
        if take is not None:
            far = best.where("id IS NOT NULL").groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("d"))
            state = state.select("query", "q", "seen").join(far, "query", "left").select("query", "q", F.coalesce("d", F.lit(float("inf"))).alias("far"), (F.col("seen") + take).alias("seen"))
            state = cut_lineage(state)
    told = best.where("id IS NULL").select("query", F.col("compared").alias("n"))
    rows = best.where("id IS NOT NULL").withColumn("place", F.row_number().over(order))
    return rows.drop("compared").join(told, "query").select("query", "id", "distance", "place", F.col("n").alias("compared"))

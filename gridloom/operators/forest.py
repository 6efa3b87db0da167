"""Random forests and stumps, grown from counts by bin.

Features are cut into bins once. All trees grow together, a level a round: one pass counts rows and
weights by (tree, node, feature, bin, class) in numpy, Spark sums these counts, and each node's best
split is found from running sums over bins. What a task holds depends on a batch of rows, what a
node brings together on features, bins and classes, whatever the table; the classes' counts of a
split's children are known from the split, so that leaves are told before the next pass.

Rows are (id, x array<double>, cls from 1 on, and w if weighted). A null or NaN component goes right
at each split, as a comparison with it is false.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tasks import importable, matrix
from .cluster import cut_lineage

#: Nodes of a forest that are sent to every task when it is applied.
SENT_NODES = 1_000_000
#: Numbers of a dense array of counts that is worked on at a time.
DENSE = 1 << 21
#: Least gain of a split, and digits to which impurities are compared.
LEAST_GAIN, DIGITS = 1e-10, 10


@dataclass(frozen=True)
class Options:
    """How trees grow. rows: of each tree, drawn without replacement (None: 5 * rows / trees, all at
    most); features: drawn for each node (None: the root of their number); depth: nodes up to it are split."""

    classes: int
    trees: int = 1
    rows: int | None = None
    features: int | None = None
    criterion: str = "gini"
    least_count: int = 1
    least_child: int = 1
    depth: int = 64
    feature_weights: Sequence[float] | None = None
    seed: int = 0


def draw(*parts: Column | int) -> Column:
    """A number in (0, 1] that depends on the parts only."""
    text = F.concat_ws(",", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)


# --- bins


def uniform_edges(rows: DataFrame, bins: int) -> np.ndarray:
    """(features, bins - 1): bins of one width between each feature's least and largest value."""
    low, high = _extent(rows)
    return low[:, None] + (high - low)[:, None] * np.arange(1, bins) / bins


def quantile_edges(rows: DataFrame, bins: int) -> np.ndarray:
    """(features, bins - 1): middles between neighbours of a feature's quantiles, of which there are
    bins; places that aren't needed, as there are fewer values, repeat the last edge."""
    share = F.array(*(F.lit((i + 0.5) / bins) for i in range(bins)))
    long = rows.select(F.posexplode("x").alias("f", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = {r.f: r.q for r in long.groupBy("f").agg(F.percentile_approx("v", share, 20 * bins).alias("q")).collect()}
    out = np.full((max(found, default=-1) + 1, bins - 1), np.inf)
    for f, q in found.items():
        each = np.unique(q)
        middle = ((each[1:] + each[:-1]) / 2)[np.diff(each) >= 1e-6]
        out[f, : len(middle)] = middle
    return out


def _extent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    long = rows.select(F.posexplode("x").alias("f", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = {r.f: (r.low, r.high) for r in long.groupBy("f").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    at = [ends.get(f, (0.0, 0.0)) for f in range(max(ends, default=-1) + 1)]
    return np.array([a for a, _ in at]), np.array([b for _, b in at])


def binned(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """rows with b array<smallint> in place of x: how many of the feature's edges a value reaches."""
    others = [c for c in rows.columns if c != "x"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != "x"), "b array<smallint>"])
    width = len(edges)
    clean = np.nan_to_num(edges, posinf=np.finfo(float).max)
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(len(others)), width)
            b = np.stack([np.searchsorted(clean[f], x[:, f], "right") for f in range(width)], axis=1).astype(np.int16) if width else np.zeros((len(x), 0), np.int16)
            cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(cuts, pa.array(b.reshape(-1)))], names=[*others, "b"])

    return rows.select(*(f"`{c}`" for c in others), F.col("x").cast("array<double>")).mapInArrow(run, schema)


# --- splits


def impurities(left: np.ndarray, total: np.ndarray, criterion: str) -> tuple[np.ndarray, np.ndarray]:
    """Of weights by class on the left of each cut (..., cuts, classes) and in all (..., classes): the
    impurity of the whole and of each cut."""
    whole = total.sum(-1)
    wl = left.sum(-1)
    wr = whole[..., None] - wl
    right = total[..., None, :] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if criterion == "gini":
            start = 1 - (total**2).sum(-1) / whole**2
            value = (wl - (left**2).sum(-1) / wl + wr - (right**2).sum(-1) / wr) / whole[..., None]
        elif criterion == "entropy":
            bits = lambda part, of: -np.where(part > 0, part * np.log2(np.where(part > 0, part, 1) / of[..., None]), 0).sum(-1)
            start = bits(total, whole) / whole
            value = (bits(left, wl) + bits(right, wr)) / whole[..., None]
        elif criterion == "twoing":
            start = np.zeros_like(whole)
            value = -(wl * wr / whole[..., None] ** 2) * np.abs(left / wl[..., None] - right / wr[..., None]).sum(-1) ** 2
        else:
            raise ValueError(criterion)
    return start, np.where((wl > 0) & (wr > 0), value, np.inf)


def _counted(state: DataFrame, classes: int, bins: int) -> DataFrame:
    """(tree, node, f, bin, cls, n, w) of state (tree, node, cls, w, b, feats); feats: the node's features, null: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node, cls, w = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(4))
            width = int(np.diff(np.asarray(batch.column(4).offsets))[0])
            b = np.asarray(batch.column(4).flatten()).reshape(-1, width).astype(np.int64)
            keys, one, own = np.unique((tree.astype(np.int64) << 40) | node, return_index=True, return_inverse=True)
            chosen = batch.column(5)
            feats = np.tile(np.arange(width), (len(keys), 1)) if chosen.null_count else np.asarray(chosen.take(pa.array(one)).flatten()).reshape(len(keys), -1).astype(np.int64)
            slots = feats.shape[1]
            for a in range(0, len(tree), max(1, DENSE // max(1, slots))):
                part = slice(a, a + max(1, DENSE // max(1, slots)))
                o = own[part]
                code = ((o[:, None] * slots + np.arange(slots)) * bins + b[part][np.arange(len(o))[:, None], feats[o]]) * classes + (cls[part].astype(np.int64) - 1)[:, None]
                each, back = np.unique(code.reshape(-1), return_inverse=True)
                n, sums = np.bincount(back, minlength=len(each)), np.bincount(back, np.repeat(w[part], slots), len(each))
                rest, c = np.divmod(each, classes)
                rest, bin_ = np.divmod(rest, bins)
                u, slot = np.divmod(rest, slots)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((keys[u] >> 40).astype(np.int32), keys[u] & ((1 << 40) - 1), feats[u, slot].astype(np.int32), bin_.astype(np.int32), (c + 1).astype(np.int32), n, sums)], names=["tree", "node", "f", "bin", "cls", "n", "w"])

    importable(state.sparkSession)
    made = state.select("tree", "node", "cls", "w", "b", "feats").mapInArrow(run, "tree int, node bigint, f int, bin int, cls int, n bigint, w double")
    return made.groupBy("tree", "node", "f", "bin", "cls").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _best(counts: DataFrame, classes: int, bins: int, criterion: str) -> DataFrame:
    """(tree, node, f, cut, gain, lefts, rights): each node's split of largest gain; of equal ones the
    first feature and cut. Bins up to cut go left; lefts, rights: rows by class."""
    lists = counts.groupBy("tree", "node", "f").agg(*(F.collect_list(c).alias(c) for c in ("bin", "cls", "n", "w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DENSE // (bins * classes))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                size = part.num_rows
                sizes = np.diff(np.asarray(part.column(3).offsets))
                at = (np.repeat(np.arange(size), sizes) * bins + np.asarray(part.column(3).flatten())) * classes + np.asarray(part.column(4).flatten()) - 1
                n, w = np.zeros(size * bins * classes, np.int64), np.zeros(size * bins * classes)
                n[at], w[at] = np.asarray(part.column(5).flatten()), np.asarray(part.column(6).flatten())
                n, w = (x.reshape(size, bins, classes).cumsum(1) for x in (n, w))
                start, value = impurities(w[:, :-1], w[:, -1], criterion)
                value = np.where((n[:, :-1].sum(-1) > 0) & (n[:, :-1].sum(-1) < n[:, -1].sum(-1)[:, None]), np.round(value, DIGITS), np.inf)
                cut = value.argmin(1) if bins > 1 else np.zeros(size, np.int64)
                low = value[np.arange(size), cut] if bins > 1 else np.full(size, np.inf)
                left = n[np.arange(size), cut]
                right = n[:, -1] - left
                cuts = pa.array(np.arange(size + 1, dtype=np.int32) * classes)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cut.astype(np.int32)), pa.array(low), pa.array(start - low), *(pa.ListArray.from_arrays(cuts, pa.array(x.reshape(-1))) for x in (left, right))], names=["tree", "node", "f", "cut", "value", "gain", "lefts", "rights"])

    each = lists.mapInArrow(run, "tree int, node bigint, f int, cut int, value double, gain double, lefts array<bigint>, rights array<bigint>")
    best = each.groupBy("tree", "node").agg(F.min(F.struct("value", "f", "cut", "gain", "lefts", "rights")).alias("s"))
    return best.select("tree", "node", "s.f", "s.cut", "s.gain", "s.lefts", "s.rights")


# --- growing


def sampled(rows: DataFrame, trees: int, n: int | None, seed: int) -> DataFrame:
    """rows with a column tree: for each tree n rows drawn without replacement by weight w (None: all).

    The n least of -ln(u) / w are taken. They are counted by steps of the logarithm of that key; rows are
    ranked one by one only in the step in which the n-th lies.
    """
    each = rows.select("*", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"))
    if n is None:
        return each
    each = each.where("w > 0").withColumn("_key", -F.ln(draw(seed, F.col("tree"), F.col("id"))) / F.col("w"))
    each = each.withColumn("_step", F.when(F.col("_key") > 0, F.floor(F.ln("_key") * 1000)).otherwise(-(1 << 40)))
    steps = each.groupBy("tree", "_step").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("tree").orderBy("_step"))
    steps = steps.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("c")).where(F.col("_before") < n).drop("c")
    steps = cut_lineage(steps)
    kept = each.join(steps, ["tree", "_step"])
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_key", "id"))
    last = kept.where(F.col("_upto") > n).withColumn("_rank", rank).where(F.col("_before") + F.col("_rank") <= n).drop("_rank")
    return kept.where(F.col("_upto") <= n).unionByName(last).drop("_key", "_step", "_upto", "_before")


def _features(options: Options, width: int) -> Column:
    """The features that a node (tree, node) draws; null if it takes all."""
    n = min(width, options.features or max(1, round(width**0.5)))
    if n == width:
        return F.lit(None).cast("array<int>")
    weights = options.feature_weights or [1.0] * width
    keys = [F.struct((-F.ln(draw(options.seed, -1, F.col("tree"), F.col("node"), f)) / w).alias("k"), F.lit(f).alias("f")) for f, w in enumerate(weights) if w > 0]
    first = F.slice(F.array_sort(F.array(*keys)), 1, n)
    return F.array_sort(F.transform(first, lambda s: s["f"]))


def train(rows: DataFrame, edges: np.ndarray, options: Options) -> DataFrame:
    """(tree, node, fid, thr, child, distr, hs, count, depth): nodes are numbered from 1 in the order
    of their levels; x[fid] < thr goes to child, else to child + 1; a child of 0 marks a leaf. distr: shares
    of the classes, hs: the most frequent class (the first of equal ones).

    edges: of the features' bins (:func:`uniform_edges`, :func:`quantile_edges` or given); splits are looked for
    at edges only.
    """
    width, bins, h = len(edges), edges.shape[1] + 1, options.classes
    least = max(1, options.least_count, options.least_child)
    weighted = rows if "w" in rows.columns else rows.withColumn("w", F.lit(1.0))
    data = cut_lineage(binned(weighted.select("id", F.col("x"), F.col("cls").cast("int").alias("cls"), F.col("w").cast("double").alias("w")), edges))
    total = data.count()
    n = options.rows or round(5 * total / options.trees)
    state = sampled(data, options.trees, n if n < total else None, options.seed).withColumn("node", F.lit(1).cast("long"))
    state = cut_lineage(state.select("tree", "node", "cls", "w", "b"))
    by_class = lambda c: F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.coalesce(F.try_element_at(c, k), F.lit(0)))
    nodes = state.groupBy("tree", "cls").count().groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("cls", "count"))).alias("m"))
    nodes = cut_lineage(nodes.select("tree", F.lit(1).cast("long").alias("node"), by_class(F.col("m")).alias("n")))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    free = dict.fromkeys(range(options.trees), 2)  # the next number of each tree's nodes
    thresholds = _thresholds(rows, edges)
    model, depth = [], 0
    while True:
        open_ = nodes.where((size("n") > least) & (F.size(F.filter("n", lambda v: v > 0)) > 1)) if depth <= options.depth else nodes.limit(0)
        open_ = open_.select("tree", "node", _features(options, width).alias("feats"))
        splits = None
        if not open_.isEmpty():
            counts = _counted(state.join(open_, ["tree", "node"]), h, bins)
            splits = _best(counts, h, bins, options.criterion).where((F.col("gain") > LEAST_GAIN) & (size("lefts") >= options.least_child) & (size("rights") >= options.least_child))
            order = F.row_number().over(Window.partitionBy("tree").orderBy("node"))
            start = F.element_at(F.create_map(*(x for t, v in free.items() for x in (F.lit(t), F.lit(v).cast("long")))), F.col("tree"))
            splits = cut_lineage(splits.withColumn("child", start + 2 * (order - 1)))
        level = nodes if splits is None else nodes.join(splits.select("tree", "node", "f", "cut", "child"), ["tree", "node"], "left")
        if splits is None:
            level = level.select("*", F.lit(None).cast("int").alias("f"), F.lit(None).cast("int").alias("cut"), F.lit(None).cast("long").alias("child"))
        most = F.array_position("n", F.array_max("n")).cast("int")
        model.append(cut_lineage(level.join(thresholds, ["f", "cut"], "left").select("tree", "node", F.col("f").alias("fid"), "thr", F.coalesce("child", F.lit(0)).cast("long").alias("child"), F.transform("n", lambda v: v / size("n")).alias("distr"), most.alias("hs"), size("n").alias("count"), F.lit(depth).alias("depth"))))
        made = {} if splits is None else {r.tree: r.n for r in splits.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not made:
            return reduce(DataFrame.unionByName, model)
        free = {t: v + 2 * made.get(t, 0) for t, v in free.items()}
        both = F.explode(F.array(F.struct(F.col("child").alias("node"), F.col("lefts").alias("n")), F.struct((F.col("child") + 1).alias("node"), F.col("rights").alias("n"))))
        nodes = cut_lineage(splits.select("tree", both.alias("c")).select("tree", "c.node", "c.n"))
        to = F.col("child") + F.when(F.get("b", F.col("f")) <= F.col("cut"), 0).otherwise(1)
        state = cut_lineage(state.join(splits.select("tree", "node", "f", "cut", "child"), ["tree", "node"]).select("tree", to.alias("node"), "cls", "w", "b"))
        depth += 1


def _thresholds(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """(f, cut, thr)"""
    f, cut = (x.reshape(-1).astype(np.int32) for x in np.indices(edges.shape))
    return rows.sparkSession.createDataFrame(pa.table({"f": f, "cut": cut, "thr": edges.reshape(-1)}))


# --- applying


def _pruned(forest: DataFrame, depth: int, count: int) -> DataFrame:
    leaf = F.lit(False)
    if depth > 0:
        leaf = leaf | (F.col("depth") >= depth)
    if count > 0:
        leaf = leaf | (F.col("count") <= count)
    return forest.withColumn("child", F.when(leaf, 0).otherwise(F.col("child")))


def leaves(rows: DataFrame, forest: DataFrame, depth: int = 0, count: int = 0, sent: int = SENT_NODES) -> DataFrame:
    """(id, tree, node): the node at which each row (id, x) ends in each tree. Nodes of that depth, or
    of that many rows, are taken for leaves.

    A forest of at most ``sent`` nodes goes to every task; a larger one is joined level by level.
    """
    nodes = _pruned(forest, depth, count).select("tree", "node", "fid", "thr", "child")
    importable(rows.sparkSession)
    if nodes.limit(sent + 1).count() <= sent:
        found = nodes.orderBy("tree", "node").toArrow()
        tree, node, fid, child = (np.asarray(found[c].fill_null(0)).astype(np.int64) for c in ("tree", "node", "fid", "child"))
        thr = np.asarray(found["thr"].fill_null(0.0))
        names = np.unique(tree)
        root = np.searchsorted(tree, names)  # a tree's nodes are 1, 2, ... without gaps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), max(int(fid.max(initial=0)) + 1, 1))
                for t, r in zip(names, root, strict=True):
                    at = np.full(len(x), r)
                    live = np.flatnonzero(child[at] > 0)
                    while len(live):
                        k = at[live]
                        right = ~(x[live, fid[k]] < thr[k])
                        at[live] = r + child[k] + right - 1
                        live = live[child[at[live]] > 0]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(node[at])], names=["id", "tree", "node"])

        return rows.select("id", F.col("x").cast("array<double>")).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, tree int, node bigint")
    nodes = cut_lineage(nodes)
    roots = cut_lineage(nodes.where("node = 1").select(F.col("tree").alias("tree"), F.col("node").alias("node")))  # a row a tree
    state = rows.select("id", "x").join(F.broadcast(roots), F.lit(True))
    done = []
    while True:
        step = state.join(nodes, ["tree", "node"])
        done.append(cut_lineage(step.where("child = 0").select("id", "tree", "node")))
        goes = F.when(F.get("x", F.col("fid")) < F.col("thr"), F.col("child")).otherwise(F.col("child") + 1)
        state = cut_lineage(step.where("child > 0").select("id", "x", "tree", goes.alias("node")))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)


def apply(rows: DataFrame, forest: DataFrame, depth: int = 0, count: int = 0, best: bool = False, sent: int = SENT_NODES) -> DataFrame:
    """(id, hs, ps): classes' shares averaged over the trees and the first class of the largest share;
    with best each tree votes for its leaf's class."""
    at = leaves(rows, forest, depth, count, sent).join(forest.select("tree", "node", "distr", "hs"), ["tree", "node"])
    share = F.transform("distr", lambda _, k: F.when(k + 1 == F.col("hs"), 1.0).otherwise(0.0)) if best else F.col("distr")
    long = at.select("id", F.posexplode(share).alias("k", "p")).groupBy("id", "k").agg(F.avg("p").alias("p"))
    ps = F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: F.round(s["p"], 12))
    return long.groupBy("id").agg(ps.alias("ps")).select("id", F.array_position("ps", F.array_max("ps")).cast("int").alias("hs"), "ps")


# --- stumps


def stumps(rows: DataFrame, bins: int, prior: float | None = None) -> DataFrame:
    """(f, err, thr) of binned rows (b, cls 0 or 1, w): each feature's least error of calling bins up to
    thr one class and those above the other; an error beyond a half is turned round. prior: the weight of class 1."""
    if prior is None:
        prior = rows.agg(F.sum(F.when(F.col("cls") == 1, F.col("w")).otherwise(0.0))).first()[0] or 0.0
    state = rows.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), (F.col("cls") + 1).cast("int").alias("cls"), "w", "b", F.lit(None).cast("array<int>").alias("feats"))
    lists = _counted(state, 2, bins).groupBy("f").agg(*(F.collect_list(c).alias(c) for c in ("bin", "cls", "w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, cls, w = (np.asarray(batch.column(k).slice(i, 1).flatten()) for k in (1, 2, 3))
                cdf = [np.cumsum(np.bincount(at[cls == c], w[cls == c], bins)) for c in (1, 2)]
                e = np.round(prior - cdf[1] + cdf[0], 12)
                least = np.minimum(e, 1 - e)
                thr = int(least.argmin())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([float(least[thr])]), pa.array([thr], pa.int32())], names=["f", "err", "thr"])

    return lists.mapInArrow(run, "f int, err double, thr int")


# --- boosted fern regression


@dataclass(frozen=True)
class Fern:
    """Tests x[fids] < thrs (the first is the highest bit) and the values of the 2 ** tests leaves."""

    fids: tuple[int, ...]
    thrs: tuple[float, ...]
    values: tuple[float, ...]


def _leaf(x: np.ndarray, fids: Sequence[int], thrs: Sequence[float]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for f, t in zip(fids, thrs, strict=True):
        out = out * 2 + (x[:, f] < t)
    return out


def train_ferns(rows: DataFrame, ferns: int, width: int, depth: int = 2, tries: int = 10, low: float = 0.0, high: float = 1.0, reg: float = 0.01, eta: float = 1.0, average: bool = False, seed: int = 0) -> list[Fern]:
    """Boosted regression of rows (x, y) by ferns on squares of residuals. Each phase draws ``tries``
    ferns with thresholds in low to high, fits their leaves to the residuals and keeps the best, if it
    is no worse than none; average: the m-th phase's target is m times y less the sum so far.

    One pass a phase: partial sums of targets by (try, leaf) give the leaves and the error, too, as the
    sum of (t - v)^2 is that of t^2 less 2 v s + v^2 n over leaves. A phase without improvement ends the training.
    """
    importable(rows.sparkSession)
    rng = np.random.default_rng(seed)
    out: list[Fern] = []
    for m in range(1, ferns + 1):
        times = m if average else 1
        drawn = [(tuple(map(int, rng.integers(0, width, depth))), tuple(map(float, rng.random(depth) * (high - low) + low))) for _ in range(tries)]
        so_far = list(out)

        def run(batches: Iterator[pa.RecordBatch], drawn=drawn, so_far=so_far, times=times) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros((len(drawn), 1 << depth), np.int64), np.zeros((len(drawn), 1 << depth))
            squares = 0.0
            for batch in batches:
                x = matrix(batch.column(0), width)
                t = times * np.asarray(batch.column(1), np.float64)
                for f in so_far:
                    t = t - np.array(f.values)[_leaf(x, f.fids, f.thrs)]
                squares += float((t * t).sum())
                for r, (fids, thrs) in enumerate(drawn):
                    at = _leaf(x, fids, thrs)
                    n[r] += np.bincount(at, minlength=1 << depth)
                    s[r] += np.bincount(at, t, 1 << depth)
            which, leaf = (a.reshape(-1).astype(np.int32) for a in np.indices(n.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(which, -1), pa.int32()), pa.array(np.append(leaf, 0), pa.int32()), pa.array(np.append(n.reshape(-1), 0)), pa.array(np.append(s.reshape(-1), squares))], names=["r", "leaf", "n", "s"])

        sums = rows.select(F.col("x").cast("array<double>"), F.col("y").cast("double")).mapInArrow(run, "r int, leaf int, n bigint, s double")
        found = sums.groupBy("r", "leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # tries * 2^depth rows
        n, s = np.zeros((tries, 1 << depth)), np.zeros((tries, 1 << depth))
        squares = 0.0
        for r in found:
            if r.r < 0:
                squares = r.s
            else:
                n[r.r, r.leaf], s[r.r, r.leaf] = r.n, r.s
        total = n[0].sum()
        mu = s.sum(1, keepdims=True) / max(total, 1)
        values = (s - mu * n) / np.maximum(n + reg * total, np.finfo(float).eps) + mu
        error = squares - 2 * (values * s).sum(1) + (values**2 * n).sum(1)
        r = len(error) - 1 - int(np.round(error, 9)[::-1].argmin())  # the last of equal ones
        if error[r] > squares + 1e-9:
            break
        out.append(Fern(*drawn[r], tuple((values[r] * (1.0 if average else eta)).tolist())))
    if average and out:
        out = [Fern(f.fids, f.thrs, tuple(v / len(out) for v in f.values)) for f in out]
    return out


def apply_ferns(rows: DataFrame, ferns: Sequence[Fern], width: int) -> DataFrame:
    """(id, y): sum of the ferns' values at each row (id, x)."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            y = np.zeros(len(x))
            for f in ferns:
                y += np.array(f.values)[_leaf(x, f.fids, f.thrs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y)], names=["id", "y"])

    return rows.select("id", F.col("x").cast("array<double>")).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, y double")

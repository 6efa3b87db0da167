"""Superpixels: k-means of pixels by place and colour in which a pixel meets the centres next to it only.

Centres begin on a grid of ``region`` pixels, moved to the least edge around. Pixels lie in blocks between
the grid's middles, a row each; all pixels of a block meet the same four centres, wherever these move. A
round joins blocks with their centres, adds up partial sums by centre, and stops for an image when its
energy hardly falls. Pixels of one label are within four blocks, so a label's connected parts are found in
one small group; parts that are too small take the label of the part before them, which
is followed by doubling pointers.

Images are pixels (img, r, c, z), z an array of channels, with sizes (img, h, w). Images that fit a row go through
:func:`of_images`, which takes all rounds of an image in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import importable, matrix
from .cluster import cut_lineage
from .hog import tiles

#: Rounds at most, and the share of the fall of energy so far that a round must still bring.
ROUNDS, LEAST = 100, 1e-5


def _regions(sizes: DataFrame, region: int) -> DataFrame:
    """(img, h, w, rows, cols): sizes with the numbers of regions."""
    up = lambda c: F.ceil(F.col(c) / region).cast("int")
    return sizes.select("img", "h", "w", up("h").alias("rows"), up("w").alias("cols")).where("h > 0 AND w > 0")


def first_centres(pixels: DataFrame, sizes: DataFrame, region: int) -> DataFrame:
    """(img, label, c): for each cell of the grid column, row and channels of the pixel of the least edge
    within one pixel of the cell's middle, the first in reading order. Edges at the border count as 0."""
    importable(pixels.sparkSession)
    kind = dict(pixels.dtypes)["img"]
    dealt = tiles(pixels, region, 4).join(_regions(sizes, region), "img").where(F.col("ty") < F.col("rows")).where(F.col("tx") < F.col("cols"))

    def work(table: pa.Table) -> pa.Table:
        h, w, ty, tx, cols = (table[n][0].as_py() for n in ("h", "w", "ty", "tx", "cols"))
        r, c = (np.asarray(table[n].combine_chunks()).astype(np.int64) for n in "rc")
        z = table["z"].combine_chunks()
        z = matrix(z, len(z[0].as_py()))
        at = {(y, x): i for i, (y, x) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
        my, mx = (min(int(region * (t + 0.5) + 0.5), n - 1) for t, n in ((ty, h), (tx, w)))

        def edge(y: int, x: int) -> float:
            if not (0 < y < h - 1 and 0 < x < w - 1):
                return 0.0
            return float(((z[at[y, x - 1]] - z[at[y, x + 1]]) ** 2).sum() + ((z[at[y + 1, x]] - z[at[y - 1, x]]) ** 2).sum())

        near = [(y, x) for y in range(max(0, my - 1), min(h - 1, my + 1) + 1) for x in range(max(0, mx - 1), min(w - 1, mx + 1) + 1)]
        y, x = min(near, key=lambda p: edge(*p))
        return pa.table({"img": table["img"].combine_chunks()[:1], "label": pa.array([ty * cols + tx], pa.int64()), "c": pa.array([[float(x), float(y), *z[at[y, x]].tolist()]], pa.list_(pa.float64()))})

    return dealt.groupBy("img", "ty", "tx").applyInArrow(work, f"img {kind}, label bigint, c array<double>")


def blocks(pixels: DataFrame, region: int) -> DataFrame:
    """(img, u, v, p): pixels (r, c, z) by the corner u, v of the grid's middles to their upper left."""
    corner = lambda c: F.floor(F.col(c) / region - 0.5).cast("int")
    return pixels.groupBy("img", corner("c").alias("u"), corner("r").alias("v")).agg(F.collect_list(F.struct("r", "c", F.col("z").cast("array<double>").alias("z"))).alias("p"))


def _met(tiles_: DataFrame, centres: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks with the centres (label, c) that they meet, in order of their labels."""
    cell = centres.join(regions.select("img", "cols"), "img").select("img", "label", "c", (F.col("label") % F.col("cols")).cast("int").alias("x"), F.floor(F.col("label") / F.col("cols")).cast("int").alias("y"))
    each = cell.withColumn("u", F.explode(F.array(F.col("x") - 1, F.col("x")))).withColumn("v", F.explode(F.array(F.col("y") - 1, F.col("y"))))
    lists = each.groupBy("img", "u", "v").agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("near"))
    return tiles_.join(lists, ["img", "u", "v"])


def _nearest(pixels: pa.StructArray, near: pa.StructArray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and channels (n, 2 + channels) of pixels, the label of the nearest centre, and its distance."""
    r, c = (np.asarray(pixels.field(n)).astype(np.float64) for n in ("r", "c"))
    labels = np.asarray(near.field("label"))
    centre = matrix(near.field("c"), len(near.field("c")[0].as_py()))
    x = np.column_stack((c, r, matrix(pixels.field("z"), centre.shape[1] - 2)))
    gap = (x[:, None, :] - centre[None]) ** 2
    d = gap[:, :, 2:].sum(2) + factor * gap[:, :, :2].sum(2)
    best = d.argmin(1)
    return x, labels[best], best, d[np.arange(len(x)), best]


def _step(met: DataFrame, factor: float) -> DataFrame:
    """(img, label, n, s, e): pixels of each centre, sums of their places and channels, and of their distances."""
    kind = dict(met.dtypes)["img"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, label, best, d = _nearest(batch.column(1).slice(i, 1).flatten(), batch.column(2).slice(i, 1).flatten(), factor)
                own, first = np.unique(best, return_index=True)
                n = np.bincount(best)[own]
                s = [x[best == b].sum(0).tolist() for b in own]
                e = np.bincount(best, d)[own]
                img = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(own), np.int32)))
                yield pa.RecordBatch.from_arrays([img, pa.array(label[first]), pa.array(n), pa.array(s, pa.list_(pa.float64())), pa.array(e)], names=["img", "label", "n", "s", "e"])

    parts = met.select("img", "p", "near").mapInArrow(run, f"img {kind}, label bigint, n bigint, s array<double>, e double")
    long = parts.select("img", "label", "n", "e", F.posexplode("s").alias("k", "s")).groupBy("img", "label", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    return long.groupBy("img", "label").agg(F.max("n").alias("n"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("l")).select("img", "label", "n", F.transform("l", lambda t: t["s"]).alias("s"), "e")


def fitted(pixels: DataFrame, sizes: DataFrame, region: int, regularization: float, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, regions, and the centres (img, label, c) of the last round of each image. A centre without
    pixels goes to 0."""
    factor = regularization / region**2
    regions = cut_lineage(_regions(sizes, region))
    tiles_ = cut_lineage(blocks(pixels, region))
    centres = cut_lineage(first_centres(pixels, sizes, region))
    state = regions.select("img", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("last"))
    done = None
    for turn in range(rounds):
        sums = cut_lineage(_step(_met(tiles_.join(state.select("img"), "img", "left_semi"), centres, regions), factor))
        energy = sums.groupBy("img").agg(F.sum("e").alias("e"))
        state = state.join(energy, "img").select("img", F.coalesce("start", "e").alias("start"), "last", "e")
        settled = F.col("last").isNotNull() & (F.col("last") - F.col("e") < LEAST * (F.col("start") - F.col("e")))
        state = cut_lineage(state.withColumn("stop", settled if turn + 1 < rounds else F.lit(True)))
        over = cut_lineage(centres.join(state.where("stop").select("img"), "img", "left_semi"))
        if done is None or not over.isEmpty():
            done = over if done is None else cut_lineage(done.unionByName(over))
        state = state.where("NOT stop").select("img", "start", F.col("e").alias("last"))
        if state.isEmpty():
            break
        moved = centres.join(state.select("img"), "img", "left_semi").join(sums, ["img", "label"], "left")
        centres = cut_lineage(moved.select("img", "label", F.when(F.col("n") > 0, F.transform("s", lambda v: v / F.col("n"))).otherwise(F.transform("c", lambda v: v * 0)).alias("c")))
    return tiles_, regions, done


def assigned(tiles_: DataFrame, regions: DataFrame, centres: DataFrame, region: int, regularization: float) -> DataFrame:
    """(img, r, c, label): the nearest centre of each pixel, the first of equally near ones."""
    importable(tiles_.sparkSession)
    met = _met(tiles_, centres, regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column(1).slice(i, 1).flatten()
                _, label, _, _ = _nearest(p, batch.column(2).slice(i, 1).flatten(), regularization / region**2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(p), np.int32))), p.field("r"), p.field("c"), pa.array(label)], names=["img", "r", "c", "label"])

    kinds = dict(tiles_.select("p.r").dtypes)["r"]
    kind = kinds.removeprefix("array<").removesuffix(">")
    return met.select("img", "p", "near").mapInArrow(run, f"img {dict(met.dtypes)['img']}, r {kind}, c {kind}, label bigint")


def _rooted(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least of the n numbers that each one is linked with by pairs."""
    root = np.arange(n)
    while True:  # each takes the least root next to it, then that root's root
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def parts_of(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, label, part, size, r, c): the connected part (four neighbours) of each pixel of a label, named by its
    first pixel in reading order."""
    importable(labels.sparkSession)
    kinds = dict(labels.dtypes)

    def work(table: pa.Table) -> pa.Table:
        r, c = (np.asarray(table[n].combine_chunks()).astype(np.int64) for n in "rc")
        w = table["w"][0].as_py()
        y0, x0 = r.min(), c.min()
        area = np.full((r.max() - y0 + 2, c.max() - x0 + 2), -1)
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        area[r - y0, c - x0] = np.arange(len(r))
        pairs = np.concatenate([np.column_stack((a.reshape(-1), b.reshape(-1))) for a, b in ((area[:-1], area[1:]), (area[:, :-1], area[:, 1:]))])
        root = _rooted(pairs[(pairs >= 0).all(1)], len(r))
        size = np.bincount(root, minlength=len(r))[root]
        return pa.table({"img": table["img"].take(pa.array(order)), "label": table["label"].take(pa.array(order)), "part": pa.array(r[root] * w + c[root]), "size": pa.array(size), "r": pa.array(r), "c": pa.array(c)})

    dealt = labels.join(sizes.select("img", "w"), "img")
    return dealt.groupBy("img", "label").applyInArrow(work, f"img {kinds['img']}, label bigint, part bigint, size bigint, r bigint, c bigint")


def cleaned(labels: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(img, r, c, label): parts of fewer than ``least`` pixels take the label of the part at their first pixel: the
    one above it, else below, left or right, if that one began earlier in reading order; the part at the
    image's first pixel keeps its own."""
    found = cut_lineage(parts_of(labels, sizes))
    small = found.where(F.col("size") < least).join(sizes.select("img", "h", "w"), "img")
    heads = small.where(F.col("part") == F.col("r") * F.col("w") + F.col("c"))
    around = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("r") + dy).alias("r"), (F.col("c") + dx).alias("c")) for k, (dy, dx) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)])))
    asked = heads.select("img", "part", F.explode(around).alias("n")).select("img", "part", "n.k", "n.r", "n.c")
    others = found.select("img", "r", "c", F.col("part").alias("to"))
    next_ = asked.join(others, ["img", "r", "c"]).where("to < part").groupBy("img", "part").agg(F.min_by("to", "k").alias("to"))
    # of parts whose first pixel is in the image: where they lead, doubled until all lead to parts that stay
    lead = cut_lineage(heads.select("img", "part").join(next_, ["img", "part"], "left").select("img", "part", F.coalesce("to", "part").alias("to")))
    while True:
        far = lead.select("img", F.col("part").alias("to"), F.col("to").alias("next"))
        new = cut_lineage(lead.join(far, ["img", "to"], "left").select("img", "part", "to", F.coalesce("next", "to").alias("next")))
        if new.where("next <> to").isEmpty():
            break
        lead = new.select("img", "part", F.col("next").alias("to"))
    names = found.select("img", F.col("part").alias("to"), F.col("label").alias("new")).distinct()
    final = lead.join(names, ["img", "to"]).select("img", "part", "new")
    return found.join(final, ["img", "part"], "left").select("img", "r", "c", F.coalesce("new", "label").alias("label"))


def _meeting(h: int, w: int, region: int) -> np.ndarray:
    """(h * w, 4): the labels of the centres that each pixel meets, in order; -1 where the grid ends."""
    rows, cols = -(-h // region), -(-w // region)
    v, u = (np.floor(np.arange(n) / region - 0.5).astype(np.int64) for n in (h, w))
    at = [(np.where((y >= 0) & (y < rows), y, -1)[:, None], np.where((x >= 0) & (x < cols), x, -1)[None]) for y in (v, v + 1) for x in (u, u + 1)]
    return np.stack([np.where((y < 0) | (x < 0), -1, y * cols + x).reshape(-1) for y, x in at], 1)


def _begun(image: np.ndarray, region: int) -> np.ndarray:
    """The centres of :func:`first_centres` of image (channels, h, w)."""
    _, h, w = image.shape
    edge = np.zeros((h, w))
    edge[1:-1, 1:-1] = ((image[:, 1:-1, :-2] - image[:, 1:-1, 2:]) ** 2).sum(0) + ((image[:, 2:, 1:-1] - image[:, :-2, 1:-1]) ** 2).sum(0)
    out = []
    for my in (min(int(region * (t + 0.5) + 0.5), h - 1) for t in range(-(-h // region))):
        for mx in (min(int(region * (t + 0.5) + 0.5), w - 1) for t in range(-(-w // region))):
            y0, x0 = max(0, my - 1), max(0, mx - 1)
            near = edge[y0 : my + 2, x0 : mx + 2]
            y, x = np.unravel_index(near.argmin(), near.shape)
            out.append([x0 + x, y0 + y, *image[:, y0 + y, x0 + x]])
    return np.array(out, np.float64)


def segmented(image: np.ndarray, region: int, regularization: float, rounds: int = ROUNDS) -> np.ndarray:
    """(h, w): the label of each pixel of image (channels, h, w) after the last round."""
    _, h, w = image.shape
    factor, met = regularization / region**2, _meeting(h, w, region)
    y, x = np.divmod(np.arange(h * w), w)
    full = np.column_stack((x, y, image.reshape(len(image), -1).T)).astype(np.float64)
    centre, start, last = _begun(image, region), None, None
    for turn in range(rounds):
        gap = (full[:, None, :] - centre[met]) ** 2
        d = gap[:, :, 2:].sum(2) + factor * gap[:, :, :2].sum(2)
        d[met < 0] = np.inf
        best = d.argmin(1)
        label = met[np.arange(len(met)), best]
        energy = d[np.arange(len(met)), best].sum()
        start = energy if start is None else start
        if turn + 1 == rounds or (last is not None and last - energy < LEAST * (start - energy)):
            break
        last = energy
        n = np.bincount(label, minlength=len(centre))
        sums = np.column_stack([np.bincount(label, f, len(centre)) for f in full.T])
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre * 0)
    return label.reshape(h, w)


def tidied(labels: np.ndarray, least: int) -> np.ndarray:
    """labels (h, w) by the rule of :func:`cleaned`."""
    h, w = labels.shape
    place = np.arange(h * w).reshape(h, w)
    down, right = labels[:-1] == labels[1:], labels[:, :-1] == labels[:, 1:]
    root = _rooted(np.concatenate([np.column_stack((place[:-1][down], place[1:][down])), np.column_stack((place[:, :-1][right], place[:, 1:][right]))]), h * w)
    size, flat = np.bincount(root, minlength=h * w), labels.reshape(-1)
    new = flat.copy()  # by the first pixel of a part
    for p in np.flatnonzero((size > 0) & (size < least)).tolist():
        r, c = divmod(p, w)
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < h and 0 <= x < w and root[y * w + x] < p:
                new[p] = new[root[y * w + x]]
                break
    return new[root].reshape(h, w)


def of_images(images: DataFrame, region: int, regularization: float, least: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(img, r, c, label): :func:`slic` of images that are rows (img, h, w, x), one image at a time; least 0 leaves all parts."""
    importable(images.sparkSession)
    small = region * region // 36 if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                image = np.asarray(batch.column(3).slice(i, 1).flatten(), np.float64).reshape(-1, h, w)
                label = tidied(segmented(image, region, regularization, rounds), small).reshape(-1)
                r, c = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(h * w, np.int32))), pa.array(r), pa.array(c), pa.array(label)], names=["img", "r", "c", "label"])

    rows = images.select("img", "h", "w", F.col("x").cast("array<double>")).where("h > 0 AND w > 0")
    return rows.mapInArrow(run, f"img {dict(images.dtypes)['img']}, r int, c int, label bigint")


def slic(pixels: DataFrame, sizes: DataFrame, region: int, regularization: float, least: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(img, r, c, label): superpixels of about region x region pixels. least: pixels of a part that stays
    (None: region ** 2 // 36)."""
    tiles_, regions, centres = fitted(pixels, sizes, region, regularization, rounds)
    labels = cut_lineage(assigned(tiles_, regions, centres, region, regularization))
    return cleaned(labels, sizes, region * region // 36 if least is None else least)

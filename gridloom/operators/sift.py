"""Key points of images at many scales, with their directions and descriptors.

An octave is a stack of ever smoother versions of an image; the next one begins with half of its
pixels. Key points are extrema of the differences of neighbouring levels, in place and level; their
place is refined by a quadratic fit. Directions are peaks of a histogram of gradients around the point, a
descriptor has 4 x 4 bins of 8 directions in its frame.

:func:`sift` takes images as rows. :func:`sift_tiles` takes pixels: an octave is a table of tiles with a border wide
enough for all that is computed of the pixels inside; a tile gives its key points and its pixels of the
next octave, which are dealt to tiles again. The number of octaves grows with the logarithm of the side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import importable, lists
from .cluster import cut_lineage
from .dsift import smooth
from .hog import halved, tiles

#: Smoothing that an image has from the start, and that of a level before the first.
NOMINAL, FIRST = 0.5, 1.6
BINS, DIRECTIONS, HISTOGRAM, CLIP, EPS = 4, 8, 36, 0.2, 1.19209290e-07

#: The places before and after each place of a histogram of directions.
BEFORE, AFTER = np.roll(np.arange(HISTOGRAM), 1), np.roll(np.arange(HISTOGRAM), -1)


@dataclass(frozen=True)
class Options:
    """levels: of an octave; first: the octave to begin with (below 0 the image is doubled); octaves: None for all.
    peak: least difference; edge: largest ratio of curvatures; magnif: a bin's side over the scale; window: the Gaussian
    window's deviation in bins; least_norm: descriptors of less are zeros."""

    levels: int = 3
    first: int = 0
    octaves: int | None = None
    peak: float = 0.0
    edge: float = 10.0
    magnif: float = 3.0
    window: float = 2.0
    least_norm: float = 0.0

    def ratio(self) -> float:
        return 2 ** (1 / self.levels)

    def sigma(self, s: float) -> float:
        """The scale of level s in pixels of its octave."""
        return FIRST * self.ratio() * 2 ** (s / self.levels)

    def step(self, s: int) -> float:
        """Smoothing that takes level s - 1 to level s."""
        return self.sigma(0) * math.sqrt(1 - 1 / self.ratio() ** 2) * self.ratio() ** s

    def count(self, h: int, w: int) -> int:
        return self.octaves if self.octaves is not None else max(math.floor(math.log2(min(h, w))) - self.first - 3, 1)

    def border(self) -> int:
        """Pixels around a key point that decide on it and its descriptor."""
        reach = [math.ceil(4 * self.step(s)) for s in range(self.levels + 2)]
        widest = self.sigma(self.levels + 0.5)
        window = max(math.sqrt(2) * self.magnif * widest * (BINS + 1) / 2 + 0.5, 4.5 * widest)
        return 8 + math.ceil(max(sum(reach), sum(reach[: self.levels]) + window)) + math.ceil(4 * FIRST)


def begun(image: np.ndarray, o: Options) -> np.ndarray:
    """The first level of the first octave."""
    for _ in range(max(0, -o.first)):
        for axis in (0, 1):
            nxt = np.take(image, np.minimum(np.arange(image.shape[axis]) + 1, image.shape[axis] - 1), axis)
            image = np.stack([image, (image + nxt) / 2], axis=axis + 1).reshape([n * (2 if a == axis else 1) for a, n in enumerate(image.shape)])
    if o.first > 0:
        d = 1 << o.first
        image = image[: image.shape[0] // d * d : d, : image.shape[1] // d * d : d]
    have = NOMINAL * 2.0**-o.first
    return smooth(image, math.sqrt(FIRST**2 - have**2)) if FIRST > have else image


def stack(base: np.ndarray, o: Options) -> list[np.ndarray]:
    """Levels -1 to levels + 1 of an octave."""
    out = [base]
    for s in range(o.levels + 2):
        out.append(smooth(out[-1], o.step(s)))
    return out


def halves(level: np.ndarray) -> np.ndarray:
    """Every second pixel, as an octave begins; odd sizes lose their last column or row."""
    return level[: level.shape[0] // 2 * 2 : 2, : level.shape[1] // 2 * 2 : 2]


def extrema(dog: np.ndarray, peak: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s, y, x of the values of dog (levels, h, w) beyond all 26 neighbours, and at least 0.8 * peak from 0."""
    inner = dog[1:-1, 1:-1, 1:-1]
    high, low = inner >= 0.8 * peak, inner <= -0.8 * peak
    for other in (dog[1:-1, 1:-1, :-2], dog[1:-1, 1:-1, 2:]):
        high &= inner > other
        low &= inner < other
    # few are left after the neighbours in the line: the other 24 are looked at for these alone
    at = np.nonzero(high | low)
    up = high[at]
    value = inner[at]
    for ds in (0, 1, 2):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (ds, dy) != (1, 1):
                    other = dog[at[0] + ds, at[1] + dy, at[2] + dx]
                    keep = np.where(up, value > other, value < other)
                    at, up, value = tuple(v[keep] for v in at), up[keep], value[keep]
    return tuple(v + 1 for v in at)


def refined(dog: np.ndarray, s: np.ndarray, y: np.ndarray, x: np.ndarray, o: Options) -> dict[str, np.ndarray]:
    """Places of extrema after at most five moves towards the top of a quadratic fit, those that are kept only."""
    _, h, w = dog.shape
    at = lambda ds, dy, dx: dog[s + ds, y + dy, x + dx]
    live = np.ones(len(s), bool)
    y, x = y.copy(), x.copy()
    for turn in range(5):
        g = np.stack([at(0, 0, 1) - at(0, 0, -1), at(0, 1, 0) - at(0, -1, 0), at(1, 0, 0) - at(-1, 0, 0)], axis=1) / 2
        mid = 2 * at(0, 0, 0)
        xx, yy, ss = at(0, 0, 1) + at(0, 0, -1) - mid, at(0, 1, 0) + at(0, -1, 0) - mid, at(1, 0, 0) + at(-1, 0, 0) - mid
        xy = (at(0, 1, 1) + at(0, -1, -1) - at(0, 1, -1) - at(0, -1, 1)) / 4
        xs = (at(1, 0, 1) + at(-1, 0, -1) - at(1, 0, -1) - at(-1, 0, 1)) / 4
        ys = (at(1, 1, 0) + at(-1, -1, 0) - at(1, -1, 0) - at(-1, 1, 0)) / 4
        a = np.stack([xx, xy, xs, xy, yy, ys, xs, ys, ss], axis=1).reshape(-1, 3, 3)
        fit = np.linalg.matrix_rank(a, tol=1e-10) == 3 if len(a) else np.zeros(0, bool)
        b = np.zeros_like(g)
        if fit.any():
            b[fit] = np.linalg.solve(a[fit], -g[fit][..., None])[..., 0]
        if turn == 4:
            break
        dx = ((b[:, 0] > 0.6) & (x < w - 2)).astype(int) - ((b[:, 0] < -0.6) & (x > 1))
        dy = ((b[:, 1] > 0.6) & (y < h - 2)).astype(int) - ((b[:, 1] < -0.6) & (y > 1))
        live &= (dx != 0) | (dy != 0)
        if not live.any():
            break
        x, y = x + dx * live, y + dy * live
    value = at(0, 0, 0) + (g * b).sum(axis=1) / 2
    det = xx * yy - xy * xy
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (xx + yy) ** 2 / det
    xn, yn, sn = x + b[:, 0], y + b[:, 1], s - 1 + b[:, 2]  # dog's first level is -1
    good = (np.abs(value) > o.peak) & (score < (o.edge + 1) ** 2 / o.edge) & (score >= 0) & (np.abs(b) < 1.5).all(axis=1)
    good &= (xn >= 0) & (xn <= w - 1) & (yn >= 0) & (yn <= h - 1) & (sn >= -1) & (sn <= o.levels + 1)
    return {"x": xn[good], "y": yn[good], "s": sn[good], "level": s[good] - 1, "kept": np.flatnonzero(good)}


def polar(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and angles (0 to 2 pi) of the gradients of a level."""
    gx, gy = halved(level[None])
    return np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)


def _window(shape: tuple[int, int], x: float, y: float, reach: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns within reach of the pixel next to x, y, margin pixels inside of the image."""
    xi, yi = int(x + 0.5), int(y + 0.5)
    return np.arange(max(yi - reach, margin), min(yi + reach, shape[0] - 1 - margin) + 1), np.arange(max(xi - reach, margin), min(xi + reach, shape[1] - 1 - margin) + 1)


def orientations(mod: np.ndarray, ang: np.ndarray, x: float, y: float, sigma: float) -> list[float]:
    """Up to four directions of the point: peaks of at least 0.8 of the highest one, of the smoothed histogram."""
    spread = 1.5 * sigma
    reach = max(math.floor(3 * spread), 1)
    ys, xs = _window(mod.shape, x, y, reach, 0)
    r2 = (ys[:, None] - y) ** 2 + (xs - x) ** 2
    near = r2 < reach * reach + 0.6
    part = np.ix_(ys, xs)
    weight = (np.exp(-r2 / (2 * spread * spread)) * mod[part])[near]
    at = HISTOGRAM * ang[part][near] / (2 * np.pi)
    first = np.floor(at - 0.5)
    off = at - first - 0.5
    first = first.astype(np.int64)
    hist = np.bincount(first % HISTOGRAM, (1 - off) * weight, HISTOGRAM) + np.bincount((first + 1) % HISTOGRAM, off * weight, HISTOGRAM)
    for _ in range(6):
        hist = (hist[BEFORE] + hist + hist[AFTER]) / 3
    before, after = hist[BEFORE], hist[AFTER]
    top = np.flatnonzero((hist > 0.8 * hist.max()) & (hist > before) & (hist > after))[:4]
    return [2 * math.pi * (i - 0.5 * (after[i] - before[i]) / (after[i] + before[i] - 2 * hist[i]) + 0.5) / HISTOGRAM for i in top.tolist()]


def descriptor(mod: np.ndarray, ang: np.ndarray, x: float, y: float, sigma: float, angle: float, o: Options) -> np.ndarray:
    """128 numbers: for each of 4 x 4 bins, row by row in the turned frame, 8 directions."""
    out = np.zeros((BINS, BINS, DIRECTIONS))
    h, w = mod.shape
    if not (0 <= int(x + 0.5) < w and 0 <= int(y + 0.5) < h - 1):
        return out.reshape(-1)
    side = o.magnif * sigma + np.finfo(float).eps
    reach = math.floor(math.sqrt(2) * side * (BINS + 1) / 2 + 0.5)
    ys, xs = _window(mod.shape, x, y, reach, 1)
    dy, dx = np.meshgrid(ys - y, xs - x, indexing="ij")
    nx, ny = (math.cos(angle) * dx + math.sin(angle) * dy) / side, (-math.sin(angle) * dx + math.cos(angle) * dy) / side
    part = np.ix_(ys, xs)
    nt = DIRECTIONS * ((ang[part] - angle) % (2 * np.pi)) / (2 * np.pi)
    weight = np.exp(-(nx * nx + ny * ny) / (2 * o.window**2)) * mod[part]
    bx, by, bt = (np.floor(v).astype(np.int64) for v in (nx - 0.5, ny - 0.5, nt))
    rx, ry, rt = nx - bx - 0.5, ny - by - 0.5, nt - bt
    flat, half = out.reshape(-1), BINS // 2
    for ix, fx in ((0, 1 - rx), (1, rx)):
        for iy, fy in ((0, 1 - ry), (1, ry)):
            inside = (bx + ix >= -half) & (bx + ix < half) & (by + iy >= -half) & (by + iy < half)
            place = (((by + iy + half) * BINS + bx + ix + half) * DIRECTIONS)[inside]
            for it, ft in ((0, 1 - rt), (1, rt)):
                flat += np.bincount(place + (bt[inside] + it) % DIRECTIONS, (weight * fx * fy * ft)[inside], len(flat))
    norm = np.linalg.norm(flat) + EPS
    if o.least_norm and norm < o.least_norm * len(ys) * len(xs):
        return np.zeros_like(flat)
    flat = np.minimum(flat / norm, CLIP)
    return flat / (np.linalg.norm(flat) + EPS)


def octave(levels: list[np.ndarray], number: int, o: Options, low: tuple[int, int] = (0, 0), high: tuple[int, int] | None = None, describe: bool = True) -> Iterator[tuple]:
    """(x, y, scale, angle, octave, level, descriptor), in pixels of the octave's array, of the extrema in the rows and
    columns low to high (without high). Unless describe, the descriptor is None."""
    dog = np.diff(np.stack(levels), axis=0)
    if min(dog.shape[1:]) < 3:
        return
    s, y, x = extrema(dog, o.peak)
    high = high or dog.shape[1:]
    own = (y >= low[0]) & (y < high[0]) & (x >= low[1]) & (x < high[1])
    found = refined(dog, s[own], y[own], x[own], o)
    fields = {}
    for i in range(len(found["x"])):
        x, y, level = float(found["x"][i]), float(found["y"][i]), int(found["level"][i])
        sigma = o.sigma(float(found["s"][i]))
        if level not in fields:
            fields[level] = polar(levels[level + 1])
        for angle in orientations(*fields[level], x, y, sigma):
            yield x, y, sigma, angle, number, level, descriptor(*fields[level], x, y, sigma, angle, o) if describe else None


def key_points(gray: np.ndarray, o: Options = Options(), describe: bool = True) -> Iterator[tuple]:  # noqa: B008  frozen
    """(x, y, scale, angle, octave, level, descriptor) of all key points of an image (h, w), x and y in its pixels."""
    base = begun(gray, o)
    for number in range(o.first, o.first + o.count(*gray.shape)):
        levels = stack(base, o)
        size = 2.0**number
        for x, y, sigma, *rest in octave(levels, number, o, describe=describe):
            yield x * size, y * size, sigma * size, *rest
        base = halves(levels[o.levels])
        if min(base.shape) < 2:
            return


KINDS = [pa.int32(), pa.int32(), pa.float64(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.float64())]
_FIELDS = "x double, y double, scale double, angle double, octave int, level int, d array<double>"


def _batch(img: pa.Array, found: list[tuple]) -> list[pa.Array]:
    n = len(found)
    cols = [pa.array([f[k] for f in found], pa.float64()) for k in range(4)] + [pa.array([f[k] for f in found], pa.int32()) for k in (4, 5)]
    last = [lists(np.array([f[6] for f in found]).reshape(n, -1))] if found[0][6] is not None else []
    return [img.take(pa.array(np.zeros(n, np.int32))), *cols, *last]


def sift(images: DataFrame, o: Options = Options(), describe: bool = True) -> DataFrame:  # noqa: B008
    """(img, x, y, scale, angle, octave, level, d) of images (img, h, w, x), of their first channel; without d unless describe."""
    importable(images.sparkSession)
    fields = _FIELDS if describe else _FIELDS.removesuffix(", d array<double>")
    names = ["img", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                gray = np.asarray(batch.column(3).slice(i, 1).flatten(), np.float64)[: h * w].reshape(h, w)
                found = list(key_points(gray, o, describe))
                if found:
                    yield pa.RecordBatch.from_arrays(_batch(batch.column(0).slice(i, 1), found), names=names)

    return images.select("img", "h", "w", F.col("x").cast("array<double>")).where("h > 1 AND w > 1").mapInArrow(run, f"img {dict(images.dtypes)['img']}, {fields}")


def sift_tiles(pixels: DataFrame, sizes: DataFrame, o: Options = Options(), side: int = 512) -> DataFrame:  # noqa: B008
    """As :func:`sift` for images given as pixels (img, r, c, v) with their sizes (img, h, w): a task holds a tile of
    side x side pixels and its border. The first octave is the image itself; its pixels are all there."""
    if o.first:
        raise ValueError("tiles begin with octave 0")
    importable(pixels.sparkSession)
    border = o.border()
    kind = dict(pixels.dtypes)["img"]
    schema = f"img {kind}, r int, c int, v double, {_FIELDS}"
    names = [f.split()[0] for f in schema.split(", ")]
    # an image has as many octaves as its smaller side asks for
    all_ = F.greatest(F.floor(F.log2(F.least("h", "w"))) - 3, F.lit(1)) if o.octaves is None else F.lit(o.octaves)
    left = sizes.select("img", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), all_.cast("int").alias("octaves")).where("h > 1 AND w > 1")
    base, out, number = pixels.select("img", "r", "c", "v"), None, 0

    def at_octave(number: int):
        def work(table: pa.Table) -> pa.Table:
            r, c, v = (np.asarray(table[n].combine_chunks()) for n in "rcv")
            h, w, ty, tx, last = (table[n][0].as_py() for n in ("h", "w", "ty", "tx", "octaves"))
            first = max(0, ty * side - border), max(0, tx * side - border)
            shape = min(h, (ty + 1) * side + border) - first[0], min(w, (tx + 1) * side + border) - first[1]
            img = table["img"].combine_chunks()[:1]
            rows = [pa.RecordBatch.from_arrays([img.slice(0, 0), *(pa.array([], t) for t in KINDS)], names=names)]
            low = ty * side - first[0], tx * side - first[1]
            if ty * side < h and tx * side < w:
                image = np.zeros(shape)
                image[r - first[0], c - first[1]] = v
                levels = stack(begun(image, o) if number == 0 else image, o)
                high = low[0] + side, low[1] + side
                size = 2.0**number
                found = [((x + first[1]) * size, (y + first[0]) * size, s * size, *rest) for x, y, s, *rest in octave(levels, number, o, low, high)]
                if found:
                    img_, *cols = _batch(img, found)
                    none = [pa.nulls(len(found), t) for t in KINDS[:3]]
                    rows.append(pa.RecordBatch.from_arrays([img_, *none, *cols], names=names))
                if number + 1 < last and min(h, w) // 2 >= 2:
                    y = np.arange(ty * side + ty * side % 2, min((ty + 1) * side, h // 2 * 2), 2)
                    x = np.arange(tx * side + tx * side % 2, min((tx + 1) * side, w // 2 * 2), 2)
                    values = levels[o.levels][np.ix_(y - first[0], x - first[1])]
                    yy, xx = np.meshgrid(y // 2, x // 2, indexing="ij")
                    n = values.size
                    rows.append(pa.RecordBatch.from_arrays([img.take(pa.array(np.zeros(n, np.int32))), pa.array(yy.reshape(-1).astype(np.int32)), pa.array(xx.reshape(-1).astype(np.int32)), pa.array(values.reshape(-1)), *(pa.nulls(n, t) for t in KINDS[3:])], names=names))
            return pa.Table.from_batches(rows)

        return work

    while not left.isEmpty():
        dealt = tiles(base, side, border).join(left.where(F.col("octaves") > number), "img")
        made = cut_lineage(dealt.groupBy("img", "ty", "tx").applyInArrow(at_octave(number), schema))
        points = made.where("x IS NOT NULL").drop("r", "c", "v")
        out = points if out is None else out.unionByName(points)
        base = made.where("x IS NULL").select("img", "r", "c", "v")
        number += 1
        left = cut_lineage(left.withColumns({"h": F.floor(F.col("h") / 2).cast("int"), "w": F.floor(F.col("w") / 2).cast("int")}).where((F.col("octaves") > number) & (F.least("h", "w") >= 2)))
    if out is None:
        return pixels.sparkSession.createDataFrame([], f"img {kind}, {_FIELDS}")
    return out

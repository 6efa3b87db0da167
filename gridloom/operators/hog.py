"""Histograms of oriented gradients of images, one image or tile a row.

Images are rows (img, h, w, x): x has the channels' pixels one after another, row by row. An image
that is too large for a row is a table of pixels; :func:`tiles` cuts it into tiles with a border, from
which the cells inside come out as they do of the whole image.

Two families are known by their rules: :func:`hog` (variants ``uoctti`` with 3 K + 4 numbers a cell, and
``dalal`` with 4 K) and :func:`fhog` (3 K + 5). Cells come out as rows (img, y, x, f).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import importable, lists, spread

#: Bound of a normalised number, and what is added under the root of a block's norm.
CLIP, EPS = 0.2, 1e-4
#: Weight of the texture numbers of fhog, and of its cells at the border, which get 7/8 of a cell's pixels.
TEXTURE, BORDER = 0.2357, 8 / 7


def strongest(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of gradients by channel (c, h, w) those of the channel with the largest one, the first of equal ones."""
    if len(gx) == 1:
        return gx[0], gy[0]
    best = (gx * gx + gy * gy).argmax(axis=0)[None]
    return np.take_along_axis(gx, best, 0)[0], np.take_along_axis(gy, best, 0)[0]


def central(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of the neighbours of each pixel of (c, h, w); 0 at the border."""
    gx, gy = np.zeros_like(image), np.zeros_like(image)
    if min(image.shape[1:]) > 2:
        gx[:, 1:-1, 1:-1] = image[:, 1:-1, 2:] - image[:, 1:-1, :-2]
        gy[:, 1:-1, 1:-1] = image[:, 2:, 1:-1] - image[:, :-2, 1:-1]
    return strongest(gx, gy)


def halved(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the differences of the neighbours of each pixel; at the border the difference to the one there is."""
    both = [np.gradient(image, axis=a) if image.shape[a] > 1 else np.zeros_like(image) for a in (2, 1)]
    return strongest(*both)


def directions(gx: np.ndarray, gy: np.ndarray, k: int, bilinear: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(direction out of 2 k, weight) of gradients: the nearest, or the two next ones by their distance."""
    at = np.arctan2(gy, gx) * (k / np.pi)
    at = np.where(at < 0, at + 2 * k, at)
    near = np.floor(at + 0.5)
    if not bilinear:
        return [(near.astype(np.int64) % (2 * k), np.ones_like(at))]
    off = at - near
    return [(near.astype(np.int64) % (2 * k), 1 - np.abs(off)), ((near + np.where(off < 0, -1, 1)).astype(np.int64) % (2 * k), np.abs(off))]


def pooled(mass: Sequence[tuple[np.ndarray, np.ndarray]], planes: int, cell: int, origin: tuple[int, int], low: tuple[int, int], high: tuple[int, int]) -> np.ndarray:
    """(planes, cells, cells): sums of weights by plane in the cells low to high (without high). mass: (plane, weight)
    of each pixel; each goes to the four cells whose centres are around it, by its distance. origin: place of the first pixel."""
    axes = []
    for size, first, a, b in zip(mass[0][0].shape, origin, low, high, strict=True):
        h = (np.arange(size) + first + 0.5) / cell - 0.5
        at = np.floor(h).astype(np.int64)
        keep = np.flatnonzero((at >= a - 1) & (at < b))
        axes.append((keep, at[keep] - (a - 1), h[keep] - at[keep], b - a + 2))
    (ys, cy, wy, ny), (xs, cx, wx, nx) = axes
    if not len(ys) or not len(xs):
        return np.zeros((planes, ny - 2, nx - 2))
    part = slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1)
    lines = np.zeros(len(ys) * planes * nx)  # each line's weights by plane and column of cells
    for plane, weight in mass:
        at = ((np.arange(len(ys))[:, None] * planes + plane[part]) * nx + cx).reshape(-1)
        w = weight[part]
        lines += np.bincount(at, (w * (1 - wx)).reshape(-1), len(lines))
        lines += np.bincount(at + 1, (w * wx).reshape(-1), len(lines))
    down = np.zeros((ny, len(ys)))
    down[cy, np.arange(len(ys))] = 1 - wy
    down[cy + 1, np.arange(len(ys))] = wy
    out = (down @ lines.reshape(len(ys), planes * nx)).reshape(ny, planes, nx)
    return out.transpose(1, 0, 2)[:, 1:-1, 1:-1]


def normalised(hist: np.ndarray, variant: str) -> np.ndarray:
    """Descriptors (d, cells, cells) of directed histograms (2 k, cells, cells): each number over the
    norms of the four blocks of 2 x 2 cells around its cell, not over CLIP."""
    k = len(hist) // 2
    flat = hist[:k] + hist[k:]
    n = np.pad((flat**2).sum(axis=0), 1, mode="edge")
    block = n[:-1, :-1] + n[:-1, 1:] + n[1:, :-1] + n[1:, 1:]
    factor = 1 / np.sqrt(block + EPS)
    four = [factor[a : a + hist.shape[1], b : b + hist.shape[2]] for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))]
    parts = [np.minimum(CLIP, f * flat) for f in four]
    if variant == "dalal":
        return np.concatenate(parts)
    if variant != "uoctti":
        raise ValueError(variant)
    directed = [np.minimum(CLIP, f * hist) for f in four]
    return np.concatenate([sum(directed) / 2, sum(parts) / 2, np.stack([p.sum(axis=0) for p in parts]) / np.sqrt(18)])


def permutation(k: int, variant: str = "uoctti") -> np.ndarray:
    """Where the numbers of a cell of the mirrored image are found."""
    turned = (k - np.arange(2 * k)) % (2 * k)
    flat = (k - np.arange(k)) % k
    sides = np.array([1, 0, 3, 2])
    if variant == "dalal":
        return np.concatenate([s * k + flat for s in sides])
    return np.concatenate([turned, 2 * k + flat, 3 * k + sides])


def _size(pixels: int, cell: int) -> int:
    return (pixels + cell // 2) // cell


def describe(image: np.ndarray, cell: int, k: int = 9, variant: str = "uoctti", bilinear: bool = False, shape: tuple[int, int] | None = None, origin: tuple[int, int] = (0, 0), low: tuple[int, int] = (0, 0), high: tuple[int, int] | None = None) -> np.ndarray:
    """(d, cells, cells) of image (c, h, w). For a tile: shape of the whole image, the place of the tile's
    first pixel, and the cells low to high that are wanted; the tile has 2 cells and a pixel more on each side."""
    shape = shape or image.shape[1:]
    gx, gy = central(image)
    return _described(gx, gy, np.hypot(gx, gy), directions(gx, gy, k, bilinear), cell, k, variant, shape, origin, low, high)


def _described(gx, gy, m, dirs, cell, k, variant, shape, origin, low, high):
    cells = tuple(_size(n, cell) for n in shape)
    high = high or cells
    if not min(cells):
        return np.zeros((4 * k if variant == "dalal" else 3 * k + 4, *cells))
    a = tuple(max(0, v - 1) for v in low)
    b = tuple(min(n, v + 1) for n, v in zip(cells, high, strict=True))
    hist = pooled([(d, m * w) for d, w in dirs], 2 * k, cell, origin, a, b)
    return normalised(hist, variant)[:, low[0] - a[0] : high[0] - a[0], low[1] - a[1] : high[1] - a[1]]


def describe_polar(modulus: np.ndarray, angle: np.ndarray, cell: int, k: int = 9, variant: str = "uoctti", bilinear: bool = False, directed: bool = True) -> np.ndarray:
    """As :func:`describe` for a field of lengths and angles. undirected: angles wrap at half a turn. Of the two directions of
    the bilinear rule each has the square of its weight, as both of its spatial weights are multiplied by it."""
    at = angle / (np.pi / k)
    first = np.floor(at)
    off = at - first
    period = 2 * k if directed else k
    one, two = (np.mod(first + d, 2 * k).astype(np.int64) % period for d in (0, 1))
    dirs = [(one, (1 - off) ** 2), (two, off**2)] if bilinear else [(np.where(1 - off > off, one, two), np.ones_like(off))]
    m = np.where(modulus > 0, modulus, 0)
    return _described(None, None, m, dirs, cell, k, variant, angle.shape, (0, 0), (0, 0), None)


def _norms(flat: np.ndarray, cell: int) -> np.ndarray:
    """Inverse norms of the blocks around cells (rows + 1, columns + 1); the outer ones repeat those next to them."""
    n = (flat**2).sum(axis=0)
    block = n[:-1, :-1] + n[:-1, 1:] + n[1:, :-1] + n[1:, 1:]
    return np.pad(1 / np.sqrt(block + EPS / 4 / cell**4), 1, mode="edge")


def describe_fhog(image: np.ndarray, cell: int = 8, k: int = 9, clip: float = 0.2, crop: bool = False) -> np.ndarray:
    """(3 k + 5, rows, columns) of image (c, h, w): 2 k directed and k undirected numbers, 4 of texture, and
    a 0. Images of under 2 x 2 whole cells have no blocks and give zeros."""
    rows, cols = image.shape[1] // cell, image.shape[2] // cell
    if min(rows, cols) < 2:
        return np.zeros((3 * k + 5, rows, cols))
    gx, gy = halved(image)
    m = np.maximum(np.hypot(gx, gy), 1e-10)
    cut = slice(0, rows * cell), slice(0, cols * cell)
    (d, w), = directions(gx[cut], gy[cut], k, False)
    hist = pooled([(d, m[cut] * w / cell**2)], 2 * k, cell, (0, 0), (0, 0), (rows, cols))
    for edge in (np.s_[:, 0], np.s_[:, -1], np.s_[:, :, 0], np.s_[:, :, -1]):
        hist[edge] *= BORDER
    flat = hist[:k] + hist[k:]
    norm = _norms(flat, cell)
    four = [norm[a : a + rows, b : b + cols] for a, b in ((1, 1), (0, 1), (1, 0), (0, 0))]  # below right, above right, below left, above left
    directed = [np.minimum(clip, f * hist) for f in four]
    out = np.concatenate([sum(directed) / 2, sum(np.minimum(clip, f * flat) for f in four) / 2, TEXTURE * np.stack([x.sum(axis=0) for x in directed]), np.zeros((1, rows, cols))])
    if crop:
        y, x = (int(n % cell < cell / 2) for n in image.shape[1:])
        out = out[:, 1 : rows - y, 1 : cols - x]
    return out


# --- tables of images


def per_image(images: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(img, y, x, f): what work makes of each image (img, h, w, x), an array (d, rows, columns)."""
    importable(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                made = work(np.asarray(batch.column(3).slice(i, 1).flatten(), np.float64).reshape(-1, h, w))
                yield cells(batch.column(0).slice(i, 1), made, 0, 0)

    return images.select("img", "h", "w", F.col("x").cast("array<double>")).where("h > 0 AND w > 0").mapInArrow(run, f"img {dict(images.dtypes)['img']}, y int, x int, f array<double>")


def cells(img: pa.Array, made: np.ndarray, y0: int, x0: int) -> pa.RecordBatch:
    """Rows (img, y, x, f) of an array (d, rows, columns) that begins at cell y0, x0."""
    d, rows, cols = made.shape
    y, x = (v.reshape(-1).astype(np.int32) for v in np.indices((rows, cols)))
    return pa.RecordBatch.from_arrays([img.take(pa.array(np.zeros(rows * cols, np.int32))), pa.array(y + np.int32(y0)), pa.array(x + np.int32(x0)), lists(made.reshape(d, -1).T)], names=["img", "y", "x", "f"])


def hog(images: DataFrame, cell: int = 8, k: int = 9, variant: str = "uoctti", bilinear: bool = False) -> DataFrame:
    """(img, y, x, f) of images (img, h, w, x)."""
    return per_image(images, lambda im: describe(im, cell, k, variant, bilinear))


def fhog(images: DataFrame, cell: int = 8, k: int = 9, clip: float = 0.2, crop: bool = False) -> DataFrame:
    """(img, y, x, f) of images (img, h, w, x)."""
    return per_image(images, lambda im: describe_fhog(im, cell, k, clip, crop))


def tiles(pixels: DataFrame, side: int, border: int) -> DataFrame:
    """Pixels (img, ch, r, c, v) with the tiles (ty, tx) in which they lie: tiles have ``side`` pixels a side and
    a border of so many; a pixel in a border is a row of each of its tiles."""
    span = lambda v: F.sequence(F.greatest(F.lit(0), F.floor((v - border) / side)), F.floor((v + border) / side)).cast("array<int>")
    once = pixels.withColumn("ty", F.explode(span(F.col("r"))))
    return once.withColumn("tx", F.explode(span(F.col("c"))))


def own_tiles(dealt: DataFrame, cell: int, tile: int) -> DataFrame:
    """The rows (h, w, ty, tx) of tiles of ``tile`` x ``tile`` cells that have cells of their image. Borders reach into others, too."""
    size = lambda c: F.floor((F.col(c) + cell // 2) / cell)
    return dealt.where((F.col("ty") * tile < size("h")) & (F.col("tx") * tile < size("w")))


def hog_tiles(pixels: DataFrame, sizes: DataFrame, cell: int = 8, k: int = 9, variant: str = "uoctti", bilinear: bool = False, tile: int = 32) -> DataFrame:
    """(img, y, x, f) of images given as pixels (img, ch, r, c, v) with their sizes (img, h, w): each task
    holds a tile of ``tile`` x ``tile`` cells, whatever the image. Missing pixels count as 0."""
    importable(pixels.sparkSession)
    side, border = tile * cell, 2 * cell + 2
    dealt = spread(own_tiles(tiles(pixels, side, border).join(sizes, "img"), cell, tile), "img", "ty", "tx")

    def work(table: pa.Table) -> pa.Table:
        ch, r, c, v = (np.asarray(table[n].combine_chunks().fill_null(0)) for n in ("ch", "r", "c", "v"))
        h, w, ty, tx = (table[n][0].as_py() for n in ("h", "w", "ty", "tx"))
        whole = _size(h, cell), _size(w, cell)
        low = ty * tile, tx * tile
        high = tuple(min(n, v + tile) for n, v in zip(whole, low, strict=True))
        if high[0] <= low[0] or high[1] <= low[1]:
            return empty
        first = max(0, ty * side - border), max(0, tx * side - border)
        last = min(h, (ty + 1) * side + border), min(w, (tx + 1) * side + border)
        image = np.zeros((int(ch.max()) + 1, last[0] - first[0], last[1] - first[1]))
        inside = (r < last[0]) & (c < last[1])
        image[ch[inside], r[inside] - first[0], c[inside] - first[1]] = v[inside]
        made = describe(image, cell, k, variant, bilinear, (h, w), first, low, high)
        return pa.Table.from_batches([cells(table["img"].combine_chunks()[:1], made, *low)])

    kind = dict(pixels.dtypes)["img"]
    schema = f"img {kind}, y int, x int, f array<double>"
    empty = pa.table({"img": pa.array([], pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), "y": pa.array([], pa.int32()), "x": pa.array([], pa.int32()), "f": pa.array([], pa.list_(pa.float64()))})
    return dealt.groupBy("img", "ty", "tx").applyInArrow(work, schema)

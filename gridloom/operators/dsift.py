"""Descriptors of gradients on a lattice, at one or several scales, one image a row.

A descriptor has 4 x 4 spatial bins of 8 directions. Gradients go to the two next directions and, by a
triangular window, to the bins around them; a Gaussian window over the descriptor weighs them, either
pixel by pixel or (flat) by its mean over each bin. Both are linear in the planes of directions, so the
bins of all descriptors of an image come from two products with banded matrices. Rows of the lattice
are worked off in strips, so that an image's descriptors are never held all at once.

Images are rows (img, h, w, x) as in :mod:`.hog`; pixels beyond the border repeat those at it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import importable, lists
from .hog import halved

BINS, DIRECTIONS, CLIP = 4, 8, 0.2
#: What is added to a norm, and numbers of the descriptors that are made at a time.
EPS, STRIP = 1.19209290e-07, 1 << 20
#: Numbers of a sampler that is kept for the next image of its size at most.
KEPT = 1 << 16


def planes(gray: np.ndarray, directions: int = DIRECTIONS) -> np.ndarray:
    """(directions, h, w): lengths of the gradients, shared between the two next directions."""
    gx, gy = halved(gray[None])
    at = np.arctan2(gy, gx) % (2 * np.pi) * (directions / (2 * np.pi))
    first = np.floor(at)
    off, m = at - first, np.hypot(gx, gy)
    one = first.astype(np.int64) % directions
    y, x = np.indices(gray.shape)
    out = np.zeros((directions, *gray.shape))
    out[one, y, x] = (1 - off) * m
    out[(one + 1) % directions, y, x] += off * m
    return out


def window(size: int, bin_: int, window_size: float, flat: bool, bins: int = BINS) -> np.ndarray:
    """Weights of the pixels -size + 1 to size - 1 around the centre of a bin."""
    o = np.arange(-size + 1, size)
    gauss = np.exp(-0.5 * ((o + size * (bin_ - 0.5 * (bins - 1))) / (size * window_size)) ** 2)
    return (1 - np.abs(o) / size) * (gauss.mean() if flat else gauss)


def sampler(n: int, places: np.ndarray, size: int, window_size: float, flat: bool, bins: int = BINS) -> np.ndarray:
    """(bins, places, n): what each of n pixels gives to each bin of the descriptors that begin at places."""
    out = np.zeros((bins, len(places), n))
    for b in range(bins):
        w = window(size, b, window_size, flat, bins)
        at = np.clip(places[:, None] + b * size + np.arange(-size + 1, size), 0, n - 1)
        np.add.at(out[b], (np.arange(len(places))[:, None], at), w)
    return out


@lru_cache(maxsize=64)
def _kept(n: int, low: int, count: int, step: int, *rest) -> np.ndarray:
    out = sampler(n, low + step * np.arange(count), *rest)
    out.flags.writeable = False
    return out


def _sampler(n: int, places: np.ndarray, step: int, *rest) -> np.ndarray:
    """:func:`sampler` of places that are step apart; images of one size share small ones."""
    if BINS * n * len(places) > KEPT:
        return sampler(n, places, *rest)
    return _kept(n, int(places[0]), len(places), step, *rest)


def _unit(d: np.ndarray) -> np.ndarray:
    return d / (np.linalg.norm(d, axis=1, keepdims=True) + EPS)


def lattice(n: int, size: int, step: int, low: int, high: int | None) -> np.ndarray:
    """First bin centres of the descriptors along n pixels, within low and high (both included)."""
    last = (n - 1 if high is None else min(high, n - 1)) - size * (BINS - 1)
    return np.arange(max(low, 0), last + 1, step)


def describe(gray: np.ndarray, size: int = 3, step: int = 1, bounds: tuple[int, int, int | None, int | None] = (0, 0, None, None), window_size: float = 2.0, flat: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, norm and descriptors (n, 128) by strips of rows. bounds: least x and y, largest x and y of
    bin centres. norm: the mass before normalising, over the descriptor's area."""
    xs, ys = lattice(gray.shape[1], size, step, bounds[0], bounds[2]), lattice(gray.shape[0], size, step, bounds[1], bounds[3])
    if not len(xs) or not len(ys):
        return
    full = planes(gray)
    right = _sampler(gray.shape[1], xs, step, size, window_size, flat)
    across = np.einsum("thw,bnw->tbnh", full, right, optimize=True)  # direction, bin, place, row
    rows = max(1, STRIP // (len(xs) * BINS * BINS * DIRECTIONS))
    centre, area = size * (BINS - 1) / 2, (size * (BINS - 1) + 1) ** 2
    for a in range(0, len(ys), rows):
        part = ys[a : a + rows]
        down = _sampler(gray.shape[0], part, step, size, window_size, flat)
        d = np.einsum("tbnh,cmh->mncbt", across, down, optimize=True).reshape(len(part) * len(xs), -1)
        norm = d.sum(axis=1) / area
        x, y = np.tile(xs, len(part)), np.repeat(part, len(xs))
        yield x + centre, y + centre, norm, _unit(np.minimum(_unit(d), CLIP))


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """image (h, w) under a Gaussian window of ceil(4 sigma) pixels to each side."""
    reach = int(np.ceil(4 * sigma))
    if not reach:
        return image
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        n = image.shape[axis]
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image, part = np.zeros(image.shape), np.empty(image.shape)
        for i, f in enumerate(w):
            np.multiply(padded[i : i + n] if axis == 0 else padded[:, i : i + n], f, out=part)
            image += part
    return image


def channels(image: np.ndarray, colour: str) -> np.ndarray:
    """The channels of image (c, h, w) of which descriptors are taken: gray, rgb, opponent or hsv."""
    if colour == "gray":
        return image[:1] if len(image) == 1 else (0.2989 * image[0] + 0.587 * image[1] + 0.114 * image[2])[None]
    if len(image) == 1:
        image = np.repeat(image, 3, axis=0)
    r, g, b = image
    if colour == "rgb":
        return image
    if colour == "opponent":
        mu = 0.3 * r + 0.59 * g + 0.11 * b
        return np.stack([mu, (r - g) / np.sqrt(2) + 0.01 * mu, (r + g - 2 * b) / np.sqrt(6) + 0.01 * mu])
    if colour == "hsv":
        high, low = image.max(0), image.min(0)
        span = np.where(high > low, high - low, 1)
        hue = np.where(high == r, (g - b) / span % 6, np.where(high == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
        return np.stack([np.where(high > low, hue, 0), np.where(high > 0, (high - low) / np.where(high > 0, high, 1), 0), high])
    raise ValueError(colour)


def many_scales(image: np.ndarray, sizes: Sequence[int] = (4, 6, 8, 10), step: int = 2, colour: str = "gray", magnif: float = 6.0, window_size: float = 1.5, contrast: float = 0.005, flat: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """size, x, y, norm and descriptors at each scale, channels one after another. The image is smoothed by
    size / magnif; lattices of all sizes have the same centres; descriptors of less contrast are zeros."""
    parts = channels(image, colour)
    for size in sizes:
        low = int(np.floor(1 + 1.5 * (max(sizes) - size))) - 1
        found = [describe(smooth(p, size / magnif), size, step, (low, low, None, None), window_size, flat) for p in parts]
        for strips in zip(*found, strict=True):
            norms = [s[2] for s in strips]
            mass = norms[0] if colour in ("gray", "opponent") else np.mean(norms, axis=0) if colour == "rgb" else norms[2]
            d = np.concatenate([s[3] for s in strips], axis=1)
            yield size, strips[0][0], strips[0][1], norms[0], np.where(mass[:, None] < contrast, 0, d)


def _images(images: DataFrame) -> DataFrame:
    importable(images.sparkSession)
    return images.select("img", "h", "w", F.col("x").cast("array<double>")).where("h > 0 AND w > 0")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for i in range(batch.num_rows):
        h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
        yield batch.column(0).slice(i, 1), np.asarray(batch.column(3).slice(i, 1).flatten(), np.float64).reshape(-1, h, w)


def dsift(images: DataFrame, size: int = 3, step: int = 1, bounds: tuple[int, int, int | None, int | None] = (0, 0, None, None), window_size: float = 2.0, flat: bool = False) -> DataFrame:
    """(img, x, y, norm, d) of images (img, h, w, x), of their first channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, image in _rows(batch):
                for x, y, norm, d in describe(image[0], size, step, bounds, window_size, flat):
                    yield pa.RecordBatch.from_arrays([img.take(pa.array(np.zeros(len(x), np.int32))), pa.array(x), pa.array(y), pa.array(norm), lists(d)], names=["img", "x", "y", "norm", "d"])

    return _images(images).mapInArrow(run, f"img {dict(images.dtypes)['img']}, x double, y double, norm double, d array<double>")


def phow(images: DataFrame, sizes: Sequence[int] = (4, 6, 8, 10), step: int = 2, colour: str = "gray", magnif: float = 6.0, window_size: float = 1.5, contrast: float = 0.005, flat: bool = True) -> DataFrame:
    """(img, x, y, norm, size, d) of images (img, h, w, x): descriptors at several scales."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, image in _rows(batch):
                for s, x, y, norm, d in many_scales(image, sizes, step, colour, magnif, window_size, contrast, flat):
                    yield pa.RecordBatch.from_arrays([img.take(pa.array(np.zeros(len(x), np.int32))), pa.array(x), pa.array(y), pa.array(norm), pa.array(np.full(len(x), s, np.int32)), lists(d)], names=["img", "x", "y", "norm", "size", "d"])

    return _images(images).mapInArrow(run, f"img {dict(images.dtypes)['img']}, x double, y double, norm double, size int, d array<double>")

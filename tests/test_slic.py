"""Superpixels against a plain loop over pixels."""

import math
from collections import deque

import numpy as np
import pytest

from gridloom.operators import slic


def plain(image, region, regularization, least, rounds=100):
    """image (h, w, channels); labels after rounds and after small parts are gone."""
    h, w, _ = image.shape
    rows, cols = math.ceil(h / region), math.ceil(w / region)
    edge = np.zeros((h, w))
    edge[1:-1, 1:-1] = ((image[1:-1, :-2] - image[1:-1, 2:]) ** 2 + (image[2:, 1:-1] - image[:-2, 1:-1]) ** 2).sum(2)
    centres = []
    for v in range(rows):
        for u in range(cols):
            x, y = min(math.floor(region * (u + 0.5) + 0.5), w - 1), min(math.floor(region * (v + 0.5) + 0.5), h - 1)
            near = [(b, a) for b in range(max(0, y - 1), min(h - 1, y + 1) + 1) for a in range(max(0, x - 1), min(w - 1, x + 1) + 1)]
            y, x = min(near, key=lambda p: edge[p])
            centres.append(np.array([x, y, *image[y, x]]))
    factor = regularization / region**2
    start = last = None
    labels = np.zeros((h, w), int)
    for _ in range(rounds):
        energy = 0.0
        for y in range(h):
            for x in range(w):
                u, v = math.floor(x / region - 0.5), math.floor(y / region - 0.5)
                best = math.inf
                for vp in range(max(0, v), min(rows - 1, v + 1) + 1):
                    for up in range(max(0, u), min(cols - 1, u + 1) + 1):
                        c = centres[vp * cols + up]
                        d = ((image[y, x] - c[2:]) ** 2).sum() + factor * ((x - c[0]) ** 2 + (y - c[1]) ** 2)
                        if d < best:
                            best, labels[y, x] = d, vp * cols + up
                energy += best
        if start is None:
            start = energy
        elif last - energy < 1e-5 * (start - energy):
            break
        last = energy
        for k in range(len(centres)):
            ys, xs = np.nonzero(labels == k)
            centres[k] = np.concatenate(([xs.mean(), ys.mean()], image[ys, xs].mean(0))) if len(ys) else centres[k] * 0
    raw = labels.copy()
    done = np.full((h, w), -1)
    for y in range(h):
        for x in range(w):
            if done[y, x] >= 0:
                continue
            label, new = labels[y, x], labels[y, x]
            for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                if 0 <= y + dy < h and 0 <= x + dx < w and done[y + dy, x + dx] >= 0:
                    new = done[y + dy, x + dx]
            done[y, x] = label
            part, queue = [(y, x)], deque([(y, x)])
            while queue:
                a, b = queue.popleft()
                for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                    p = a + dy, b + dx
                    if 0 <= p[0] < h and 0 <= p[1] < w and done[p] < 0 and labels[p] == label:
                        done[p] = label
                        part.append(p)
                        queue.append(p)
            if len(part) < least:
                for p in part:
                    done[p] = new
    return raw, done


def images():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:31, :44]
    shapes = np.stack([(np.hypot(y - 15, x - 20) < 9) * 1.0, (x > 30) * 0.7, y / 31], axis=2)
    return {1: shapes + rng.normal(size=shapes.shape) / 8, 2: rng.normal(size=(17, 9, 3)), 3: np.ones((6, 8, 3)), 4: rng.normal(size=(1, 5, 3))}


def tables(spark, ims):
    pixels = spark.createDataFrame([(i, y, x, im[y, x].tolist()) for i, im in ims.items() for y in range(im.shape[0]) for x in range(im.shape[1])], "img long, r int, c int, z array<double>")
    return pixels, spark.createDataFrame([(i, *im.shape[:2]) for i, im in ims.items()], "img long, h int, w int")


@pytest.mark.parametrize("region,regularization,least", [(8, 1.0, None), (5, 0.05, 6)])
def test_slic(spark, region, regularization, least):
    ims = images()
    pixels, sizes = tables(spark, ims)
    got = {(r.img, r.r, r.c): r.label for r in slic.slic(pixels, sizes, region, regularization, least).collect()}
    small = region * region // 36 if least is None else least
    for i, im in ims.items():
        _, want = plain(im, region, regularization, small)
        assert all(got[i, y, x] == want[y, x] for y in range(im.shape[0]) for x in range(im.shape[1])), i
    assert len(got) == sum(im.shape[0] * im.shape[1] for im in ims.values())


def test_two_rounds(spark):
    ims = images()
    pixels, sizes = tables(spark, ims)
    tiles, regions, centres = slic.fitted(pixels, sizes, 6, 0.3, rounds=2)
    got = {(r.img, r.r, r.c): r.label for r in slic.assigned(tiles, regions, centres, 6, 0.3).collect()}
    for i, im in ims.items():
        raw, _ = plain(im, 6, 0.3, 0, rounds=2)
        assert all(got[i, y, x] == raw[y, x] for y in range(im.shape[0]) for x in range(im.shape[1]))


def test_cleaned(spark):
    """Chains of small parts end in a large one; the first part of the image keeps its label."""
    labels = np.array([[9, 1, 2, 2, 2], [3, 1, 4, 2, 2], [3, 5, 4, 2, 2], [6, 6, 6, 6, 6]])
    table = spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(labels)], "img long, r int, c int, label long")
    sizes = spark.createDataFrame([(1, 4, 5)], "img long, h int, w int")
    got = np.zeros((4, 5), int)
    for r in slic.cleaned(table, sizes, 3).collect():
        got[r.r, r.c] = r.label
    assert got.tolist() == [[9, 9, 2, 2, 2], [9, 9, 2, 2, 2], [9, 9, 2, 2, 2], [6, 6, 6, 6, 6]]

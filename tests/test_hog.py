"""Gradient histograms against loops over pixels, tiles against whole images."""

import math

import numpy as np
import pytest

from gridloom.operators import hog


def plain(image, cell, k, variant, bilinear, polar=None):
    """Cells by the definition: pixel by pixel, cell by cell. image: (c, h, w); polar: (modulus, angle, directed) instead."""
    h, w = (polar[0] if polar else image[0]).shape
    rows, cols = (h + cell // 2) // cell, (w + cell // 2) // cell
    hist = np.zeros((2 * k, rows, cols))
    for y in range(h):
        for x in range(w):
            if polar:
                m, at = polar[0][y, x], polar[1][y, x] / (math.pi / k)
                lo, off = math.floor(at), at - math.floor(at)
                period = 2 * k if polar[2] else k
                dirs = [(lo % (2 * k) % period, (1 - off) ** 2), ((lo + 1) % (2 * k) % period, off**2)] if bilinear else [((lo if 1 - off > off else lo + 1) % (2 * k) % period, 1)]
            else:
                if not (0 < y < h - 1 and 0 < x < w - 1):
                    continue
                g = [(c[y, x + 1] - c[y, x - 1], c[y + 1, x] - c[y - 1, x]) for c in image]
                gx, gy = max(g, key=lambda v: v[0] ** 2 + v[1] ** 2)
                m = math.hypot(gx, gy)
                score = sorted(((abs(s), -o, o + k * (s < 0)) for o in range(k) for s in [gx * math.cos(o * math.pi / k) + gy * math.sin(o * math.pi / k)]), reverse=True)
                dirs = [(score[0][2], 1)]
                if bilinear:
                    off = math.acos(min(score[0][0] / max(m, 1e-10), 1)) / (math.pi / k)
                    dirs = [(score[0][2], 1 - off), (score[1][2], off)]
            hy, hx = (y + 0.5) / cell - 0.5, (x + 0.5) / cell - 0.5
            by, bx = math.floor(hy), math.floor(hx)
            for o, ow in dirs:
                for cy, wy in ((by, 1 - hy + by), (by + 1, hy - by)):
                    for cx, wx in ((bx, 1 - hx + bx), (bx + 1, hx - bx)):
                        if 0 <= cy < rows and 0 <= cx < cols:
                            hist[o, cy, cx] += m * ow * wy * wx
    flat = hist[:k] + hist[k:]
    n = (flat**2).sum(0)
    at = lambda y, x: n[min(max(y, 0), rows - 1), min(max(x, 0), cols - 1)]
    out = np.zeros((4 * k if variant == "dalal" else 3 * k + 4, rows, cols))
    for y in range(rows):
        for x in range(cols):
            four = [1 / math.sqrt(sum(at(y + a, x + b) for a in (dy, dy + 1) for b in (dx, dx + 1)) + 1e-4) for dy in (-1, 0) for dx in (-1, 0)]
            cut = lambda v, four=four: np.array([np.minimum(0.2, f * v) for f in four])
            u = cut(flat[:, y, x])
            out[:, y, x] = u.reshape(-1) if variant == "dalal" else np.concatenate([cut(hist[:, y, x]).sum(0) / 2, u.sum(0) / 2, u.sum(1) / math.sqrt(18)])
    return out


def picture(seed, c=1, h=45, w=52):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=(c, h, w)), axis=2) / 5 + rng.normal(size=(c, h, w)) / 10


@pytest.mark.parametrize("cell,k,variant,bilinear,c", [(8, 9, "uoctti", False, 1), (8, 9, "dalal", False, 3), (4, 5, "uoctti", True, 1), (16, 4, "dalal", True, 3), (7, 9, "uoctti", False, 1)])
def test_describe(cell, k, variant, bilinear, c):
    im = picture(cell, c)
    assert np.allclose(hog.describe(im, cell, k, variant, bilinear), plain(im, cell, k, variant, bilinear))


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("bilinear", [True, False])
def test_polar(directed, bilinear):
    rng = np.random.default_rng(1)
    m, a = rng.normal(size=(30, 41)), rng.uniform(-7, 7, size=(30, 41))
    assert np.allclose(hog.describe_polar(m, a, 8, 9, "uoctti", bilinear, directed), plain(None, 8, 9, "uoctti", bilinear, (np.maximum(m, 0), a, directed)))


@pytest.mark.parametrize("variant", ["uoctti", "dalal"])
@pytest.mark.parametrize("k", [3, 4, 9])
def test_flipping(variant, k):
    """The mirrored image has the mirrored cells, with their numbers permuted."""
    im = picture(k, h=48, w=64)
    a, b = (hog.describe(x, 8, k, variant, True) for x in (im, im[:, :, ::-1]))
    assert np.allclose(b, a[hog.permutation(k, variant)][:, :, ::-1], atol=1e-9)


def test_round_field():
    """The gradients of a field, given as lengths and angles, give the same cells."""
    v = np.linspace(-1, 1, 64)
    im = (v[None] ** 2 + v[:, None] ** 2)[None] + 0.01 * picture(3, 1, 64, 64)
    gx, gy = hog.central(im)
    assert np.allclose(hog.describe(im, 8), hog.describe_polar(np.hypot(gx, gy), np.arctan2(gy, gx), 8))


def plain_fhog(im, cell, k):
    rows, cols = im.shape[1] // cell, im.shape[2] // cell
    hist = np.zeros((2 * k, rows, cols))
    for y in range(rows * cell):
        for x in range(cols * cell):
            def diff(a, n, i):
                lo, hi = max(i - 1, 0), min(i + 1, n - 1)
                return (a[hi] - a[lo]) / (hi - lo)
            gx, gy = max(((diff(c[y], im.shape[2], x), diff(c[:, x], im.shape[1], y)) for c in im), key=lambda v: v[0] ** 2 + v[1] ** 2)
            o = math.floor(math.atan2(gy, gx) % (2 * math.pi) * k / math.pi + 0.5) % (2 * k)
            hy, hx = (y + 0.5) / cell - 0.5, (x + 0.5) / cell - 0.5
            for cy, wy in ((math.floor(hy), 1 - hy % 1), (math.floor(hy) + 1, hy % 1)):
                for cx, wx in ((math.floor(hx), 1 - hx % 1), (math.floor(hx) + 1, hx % 1)):
                    if 0 <= cy < rows and 0 <= cx < cols:
                        hist[o, cy, cx] += max(math.hypot(gx, gy), 1e-10) * wy * wx / cell**2
    for y in range(rows):
        for x in range(cols):
            hist[:, y, x] *= (8 / 7) ** ((y in (0, rows - 1)) + (x in (0, cols - 1)))
    flat = hist[:k] + hist[k:]
    n = (flat**2).sum(0)
    block = lambda y, x: (lambda a, b: 1 / math.sqrt(n[a : a + 2, b : b + 2].sum() + 1e-4 / 4 / cell**4))(min(max(y, 0), rows - 2), min(max(x, 0), cols - 2))
    out = np.zeros((3 * k + 5, rows, cols))
    for y in range(rows):
        for x in range(cols):
            four = [block(y, x), block(y - 1, x), block(y, x - 1), block(y - 1, x - 1)]
            d, u = (np.array([np.minimum(0.2, f * v[:, y, x]) for f in four]) for v in (hist, flat))
            out[:, y, x] = np.concatenate([d.sum(0) / 2, u.sum(0) / 2, 0.2357 * d.sum(1), [0]])
    return out


@pytest.mark.parametrize("cell,c,h,w", [(8, 1, 40, 40), (4, 3, 23, 30), (8, 1, 16, 23)])
def test_fhog(cell, c, h, w):
    im = picture(5, c, h, w)
    got = hog.describe_fhog(im, cell)
    assert np.allclose(got, plain_fhog(im, cell, 9))
    y, x = (int(n % cell < cell / 2) for n in (h, w))
    assert np.array_equal(hog.describe_fhog(im, cell, crop=True), got[:, 1 : got.shape[1] - y, 1 : got.shape[2] - x])


def test_small():
    assert hog.describe_fhog(np.ones((1, 5, 30))).shape == (32, 0, 3) and not hog.describe_fhog(np.ones((1, 12, 30))).any()
    assert hog.describe(np.ones((1, 2, 3)), 8).shape == (31, 0, 0)


@pytest.mark.parametrize("tile,variant", [(1, "uoctti"), (2, "dalal"), (5, "uoctti")])
def test_tiles(spark, tile, variant):
    """Cells of tiles are those of the whole image, whatever the tiling."""
    ims = {1: picture(1, 2, 61, 43), 2: picture(2, 1, 24, 90), 3: picture(3, 1, 8, 8)}
    pixels = [(i, c, y, x, float(v)) for i, im in ims.items() for (c, y, x), v in np.ndenumerate(im)]
    df = spark.createDataFrame(pixels, "img long, ch int, r int, c int, v double")
    sizes = spark.createDataFrame([(i, *im.shape[1:]) for i, im in ims.items()], "img long, h int, w int")
    got = {(r.img, r.y, r.x): r.f for r in hog.hog_tiles(df, sizes, 8, 9, variant, tile=tile).collect()}
    want = {(i, y, x): d[:, y, x] for i, im in ims.items() for d in [hog.describe(im, 8, 9, variant)] for y in range(d.shape[1]) for x in range(d.shape[2])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_images(spark):
    ims = {1: picture(1, 1, 40, 48), 2: picture(2, 3, 33, 20)}
    df = spark.createDataFrame([(i, *im.shape[1:], im.reshape(-1).tolist()) for i, im in ims.items()] + [(3, 0, 0, [])], "img long, h int, w int, x array<double>")
    for made, own in ((hog.hog(df), lambda im: hog.describe(im, 8)), (hog.fhog(df, 4), lambda im: hog.describe_fhog(im, 4))):
        got = {(r.img, r.y, r.x): r.f for r in made.collect()}
        assert len(got) == sum(d.shape[1] * d.shape[2] for d in map(own, ims.values()))
        assert all(np.allclose(got[i, y, x], own(ims[i])[:, y, x]) for i, y, x in list(got)[:20])


def test_tiles_outside_of_the_image_get_no_pixels(spark):
    pixels = spark.range(32 * 32).selectExpr("0 AS img", "0 AS ch", "CAST(id / 32 AS int) AS r", "CAST(id % 32 AS int) AS c", "rand(1) AS v")
    sizes = spark.createDataFrame([(0, 32, 32)], "img int, h int, w int")
    made = hog.hog_tiles(pixels, sizes, variant="dalal", tile=2)
    assert made.count() == 16
    met = hog.own_tiles(hog.tiles(pixels, 16, 18).join(sizes, "img"), 8, 2)
    assert sorted((t.ty, t.tx) for t in met.select("ty", "tx").distinct().collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]

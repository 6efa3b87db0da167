"""Key points of a synthetic field, their descriptors against plain sums, tiles against whole images."""

import math

import numpy as np
import pytest

from gridloom.operators import sift as sf
from gridloom.operators.dsift import smooth


def blobs(h, w, places):
    y, x = np.mgrid[:h, :w]
    return sum(a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s)) for cy, cx, s, a in places)


PLACES = [(30.3, 41.6, 4.0, 1.0), (70.8, 24.2, 7.0, -1.5), (60.5, 80.1, 3.0, 1.2), (25.0, 90.7, 6.0, 1.0)]


def test_places():
    """Each blob is found within half a cell, at its scale."""
    found = list(sf.key_points(blobs(100, 120, PLACES), sf.Options(peak=0.02, edge=3.0)))
    for cy, cx, s, _ in PLACES:
        near = min(found, key=lambda f: math.hypot(f[1] - cy, f[0] - cx) + abs(math.log(f[2] / s)))
        assert abs(near[1] - cy) < 0.5 and abs(near[0] - cx) < 0.5
        assert 0.7 < near[2] / s < 1.45


def test_levels():
    """A level's smoothing adds up to its scale."""
    im = np.random.default_rng(1).normal(size=(90, 90))
    o = sf.Options()
    levels = sf.stack(sf.begun(im, o), o)
    assert len(levels) == o.levels + 3
    for s in range(-1, o.levels + 2):
        direct = smooth(im, math.sqrt(o.sigma(s) ** 2 - sf.NOMINAL**2))
        assert np.abs(levels[s + 1] - direct)[25:-25, 25:-25].max() < 0.01
    assert sf.halves(levels[0][:89, :90]).shape == (44, 45)


def test_doubled():
    im = np.arange(12.0).reshape(3, 4)
    o = sf.Options(first=-1)
    up = im
    for axis in (0, 1):
        nxt = np.take(up, np.minimum(np.arange(up.shape[axis]) + 1, up.shape[axis] - 1), axis)
        up = np.insert((up + nxt) / 2, range(up.shape[axis]), up, axis=axis)
    have = sf.NOMINAL * 2
    assert np.allclose(sf.begun(im, o), smooth(up, math.sqrt(sf.FIRST**2 - have**2)))
    assert sf.begun(np.zeros((9, 11)), sf.Options(first=1)).shape == (4, 5)


def plain_descriptor(level, x, y, sigma, angle, o):
    h, w = level.shape
    d = np.zeros((4, 4, 8))
    side = o.magnif * sigma
    reach = math.floor(math.sqrt(2) * side * 2.5 + 0.5)
    diff = lambda a, i: (a[min(i + 1, len(a) - 1)] - a[max(i - 1, 0)]) / (min(i + 1, len(a) - 1) - max(i - 1, 0))
    for py in range(max(1, int(y + 0.5) - reach), min(h - 2, int(y + 0.5) + reach) + 1):
        for px in range(max(1, int(x + 0.5) - reach), min(w - 2, int(x + 0.5) + reach) + 1):
            gx, gy = diff(level[py], px), diff(level[:, px], py)
            nx = (math.cos(angle) * (px - x) + math.sin(angle) * (py - y)) / side
            ny = (-math.sin(angle) * (px - x) + math.cos(angle) * (py - y)) / side
            t = ((math.atan2(gy, gx) - angle) % (2 * math.pi)) * 4 / math.pi
            k = math.hypot(gx, gy) * math.exp(-(nx * nx + ny * ny) / (2 * o.window**2))
            for by in range(-2, 2):
                for bx in range(-2, 2):
                    a = max(0, 1 - abs(nx - bx - 0.5)) * max(0, 1 - abs(ny - by - 0.5))
                    d[by + 2, bx + 2, int(t) % 8] += k * a * (1 - t + int(t))
                    d[by + 2, bx + 2, (int(t) + 1) % 8] += k * a * (t - int(t))
    d = d.reshape(-1)
    d = np.minimum(d / np.linalg.norm(d), 0.2)
    return d / np.linalg.norm(d)


def test_descriptor():
    level = smooth(np.random.default_rng(2).normal(size=(60, 70)), 2.0)
    o = sf.Options()
    mod, ang = sf.polar(level)
    for x, y, sigma, angle in ((30.2, 25.7, 2.0, 0.4), (5.0, 3.3, 2.5, 4.0), (66.4, 57.2, 1.7, 6.1)):
        assert np.allclose(sf.descriptor(mod, ang, x, y, sigma, angle, o), plain_descriptor(level, x, y, sigma, angle, o), atol=1e-6)
    assert not sf.descriptor(mod, ang, 30.0, 59.0, 2.0, 0.0, o).any()  # on the last row
    assert not sf.descriptor(mod, ang, 30.0, 25.0, 2.0, 0.0, sf.Options(least_norm=1e9)).any()


def test_orientation():
    """A slope has one direction, its own."""
    y, x = np.mgrid[:41, :41]
    for a in (0.3, 2.0, 4.5):
        got = sf.orientations(*sf.polar(math.cos(a) * x + math.sin(a) * y), 20.2, 19.8, 2.0)
        assert len(got) == 1 and abs(got[0] - a) < 0.02
    # two directions of equal strength
    assert len(sf.orientations(*sf.polar(np.abs(0.9 * (x - 20.0) + 0.4 * (y - 20.0))), 20.0, 20.0, 2.0)) == 2


def test_turned_image():
    """The descriptor of a blob pattern turned by a quarter is the same, at the turned place."""
    im = blobs(89, 89, [(45, 45, 4, 1.0), (45, 53, 3, 0.6), (38, 45, 3, 0.4)])  # octaves take pixels of the same parity
    one, two = (list(sf.key_points(v, sf.Options(peak=0.02))) for v in (im, np.rot90(im)))
    assert len(one) == len(two) > 0
    for f in one:
        # rot90 takes column x to row 88 - x
        g = min(two, key=lambda g: abs(g[1] - (88 - f[0])) + abs(g[0] - f[1]) + abs(((g[3] - f[3] + math.pi / 2) + math.pi) % (2 * math.pi) - math.pi))
        assert abs(g[1] - (88 - f[0])) < 1e-6 and np.allclose(f[6], g[6], atol=1e-6)


def texture(seed, h, w):
    return smooth(np.random.default_rng(seed).normal(size=(h, w)), 1.5) * 4


def rows(df):
    return sorted((r.img, round(r.x, 6), round(r.y, 6), round(r.scale, 6), round(r.angle, 6), r.octave, r.level, *[round(v, 5) + 0.0 for v in r.d]) for r in df.collect())


@pytest.mark.parametrize("side", [64, 100])
def test_tiles(spark, side):
    ims = {1: texture(1, 150, 133), 2: texture(2, 48, 210), 3: np.zeros((20, 20))}
    o = sf.Options(peak=0.02)
    whole = sf.sift(spark.createDataFrame([(i, *im.shape, im.reshape(-1).tolist()) for i, im in ims.items()], "img long, h int, w int, x array<double>"), o)
    pixels = spark.createDataFrame([(i, y, x, float(v)) for i, im in ims.items() for (y, x), v in np.ndenumerate(im)], "img long, r int, c int, v double")
    sizes = spark.createDataFrame([(i, *im.shape) for i, im in ims.items()], "img long, h int, w int")
    got, want = rows(sf.sift_tiles(pixels, sizes, o, side)), rows(whole)
    assert len(want) > 100 and {w[5] for w in want} >= {0, 1}
    assert got == want


def test_extrema_plain():
    """Candidates against a look at all 26 neighbours of each value, ties among them."""
    dog = np.random.default_rng(7).integers(-4, 5, size=(5, 30, 40)).astype(float)
    for peak in (0.0, 2.0):
        want = []
        for s in range(1, 4):
            for y in range(1, 29):
                for x in range(1, 39):
                    v, part = dog[s, y, x], np.delete(dog[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2].reshape(-1), 13)
                    if (v >= 0.8 * peak and (v > part).all()) or (v <= -0.8 * peak and (v < part).all()):
                        want.append((s, y, x))
        assert want and [tuple(map(int, p)) for p in zip(*sf.extrema(dog, peak), strict=True)] == want


def test_without_descriptors(spark, monkeypatch):
    """Who asks for no descriptors gets the same points, and none is computed."""
    im, o = texture(4, 90, 80), sf.Options(peak=0.02)
    want = [p[:6] for p in sf.key_points(im, o)]
    df = spark.createDataFrame([(1, 90, 80, im.reshape(-1).tolist())], "img long, h int, w int, x array<double>")
    got = sf.sift(df, o, describe=False)
    assert got.columns == ["img", "x", "y", "scale", "angle", "octave", "level"]
    assert len(want) > 20 and [tuple(r)[1:] for r in got.collect()] == want
    monkeypatch.setattr(sf, "descriptor", None)
    assert [p[:6] for p in sf.key_points(im, o, False)] == want

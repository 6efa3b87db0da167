"""Descriptors on a lattice against plain sums over pixels."""

import math

import numpy as np
import pytest

from gridloom.operators import dsift as ds


def picture(seed, h=40, w=47):
    return np.cumsum(np.random.default_rng(seed).normal(size=(h, w)), axis=1) / 4


def plain(gray, size, x0, y0, window, flat):
    """The descriptor whose first bin centre is x0, y0."""
    h, w = gray.shape
    d = np.zeros((4, 4, 8))
    weight = lambda o, b: math.exp(-0.5 * ((o + size * (b - 1.5)) / (size * window)) ** 2)
    mean = [np.mean([weight(o, b) for o in range(-size + 1, size)]) for b in range(4)]
    diff = lambda a, i: (a[min(i + 1, len(a) - 1)] - a[max(i - 1, 0)]) / (min(i + 1, len(a) - 1) - max(i - 1, 0))
    for by in range(4):
        for bx in range(4):
            for oy in range(-size + 1, size):
                for ox in range(-size + 1, size):
                    y, x = (min(max(v, 0), n - 1) for v, n in ((y0 + by * size + oy, h), (x0 + bx * size + ox, w)))
                    gx, gy = diff(gray[y], x), diff(gray[:, x], y)
                    a = math.atan2(gy, gx) % (2 * math.pi) * 4 / math.pi
                    t = int(a)
                    k = (1 - abs(oy) / size) * (1 - abs(ox) / size) * (mean[by] * mean[bx] if flat else weight(oy, by) * weight(ox, bx)) * math.hypot(gx, gy)
                    d[by, bx, t % 8] += k * (1 - a + t)
                    d[by, bx, (t + 1) % 8] += k * (a - t)
    d = d.reshape(-1)
    norm = d.sum() / (3 * size + 1) ** 2
    unit = lambda v: v / (np.linalg.norm(v) + 1.19209290e-07)
    return norm, unit(np.minimum(unit(d), 0.2))


@pytest.mark.parametrize("size,step,bounds,window,flat", [(3, 7, (0, 0, None, None), 2.0, False), (4, 10, (2, 5, 40, 30), 5.0, False), (3, 6, (0, 0, None, None), 1.5, True), (5, 9, (1, 0, None, 38), 1.0, True)])
def test_describe(size, step, bounds, window, flat, monkeypatch):
    monkeypatch.setattr(ds, "STRIP", 700)  # some strips
    im = picture(size)
    strips = list(ds.describe(im, size, step, bounds, window, flat))
    x, y, norm, d = (np.concatenate([s[i] for s in strips]) for i in range(4))
    high = bounds[2] or 46, bounds[3] or 39
    want = [(a, b) for b in range(bounds[1], high[1] - 3 * size + 1, step) for a in range(bounds[0], high[0] - 3 * size + 1, step)]
    assert [(a - 1.5 * size, b - 1.5 * size) for a, b in zip(x, y, strict=True)] == want and len(strips) > 1
    for i, (a, b) in enumerate(want):
        n, v = plain(im, size, a, b, window, flat)
        assert np.isclose(norm[i], n) and np.allclose(d[i], v)


def test_flat_is_close():
    """The flat window is an approximation of the other one."""
    im = ds.smooth(picture(9, 120, 140), 1.0)
    a, b = (next(ds.describe(im, 4, 10, (20, 20, 110, 100), 5.0, f))[3] for f in (False, True))
    assert (a - b).std() / a.std() < 0.1


def test_smooth():
    im = picture(2, 20, 24)
    reach = math.ceil(4 * 1.3)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 1.3) ** 2)
    w /= w.sum()
    at = lambda y, x: im[min(max(y, 0), 19), min(max(x, 0), 23)]
    want = [[sum(w[i + reach] * w[j + reach] * at(y + i, x + j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)) for x in (0, 5, 23)] for y in (0, 9, 19)]
    assert np.allclose(ds.smooth(im, 1.3)[np.ix_([0, 9, 19], [0, 5, 23])], want)


@pytest.mark.parametrize("colour,parts", [("gray", 1), ("rgb", 3), ("opponent", 3), ("hsv", 3)])
def test_many_scales(colour, parts):
    import colorsys

    rng = np.random.default_rng(4)
    im = np.clip(np.stack([picture(i, 44, 50) for i in range(3)]) / 6 + 0.5 + rng.normal(size=(3, 44, 50)) / 50, 0, 1)
    im[:, 22:] = 0.4  # without contrast
    if colour == "hsv":
        made = ds.channels(im, "hsv")
        assert np.allclose(made[:, 7, 9], colorsys.rgb_to_hsv(*im[:, 7, 9]))
    seen = {}
    for size, x, y, norm, d in ds.many_scales(im, (4, 6), 2, colour):
        seen.setdefault(size, []).append((x, y, norm, d))
        assert d.shape[1] == 128 * parts
    assert set(seen) == {4, 6}
    for size, strips in seen.items():
        x, y, norm, d = (np.concatenate([s[i] for s in strips]) for i in range(4))
        low = math.floor(1 + 1.5 * (6 - size)) - 1
        assert (x.min(), y.min()) == (low + 1.5 * size, low + 1.5 * size)
        zero = ~d.any(axis=1)
        assert zero.any() and not zero.all() and (colour != "gray" or np.array_equal(zero, norm < 0.005))


def test_tables(spark):
    ims = {1: picture(1, 30, 32), 2: picture(2, 26, 40), 3: picture(3, 8, 8)}
    df = spark.createDataFrame([(i, *im.shape, im.reshape(-1).tolist()) for i, im in ims.items()] + [(4, 0, 0, [])], "img long, h int, w int, x array<double>")
    got = {(r.img, r.x, r.y): (r.norm, r.d) for r in ds.dsift(df, 3, 5).collect()}
    want = {(i, a, b): (n, v) for i, im in ims.items() for xs, ys, ns, vs in ds.describe(im, 3, 5) for a, b, n, v in zip(xs, ys, ns, vs, strict=True)}
    assert got.keys() == want.keys() and all(np.allclose(got[k][1], want[k][1]) for k in want)
    rows = ds.phow(df, (3, 4), 4).collect()
    assert len(rows) == sum(len(s[1]) for im in ims.values() for s in ds.many_scales(im[None], (3, 4), 4))


def test_images_of_one_size_share_samplers(monkeypatch):
    rng, made, sampler = np.random.default_rng(3), [], ds.sampler
    ds._kept.cache_clear()
    monkeypatch.setattr(ds, "sampler", lambda *a: made.append(a) or sampler(*a))
    images = [rng.random((21, 30)) for _ in range(3)]
    got = [list(ds.describe(g, 3, 4, window_size=1.5, flat=True)) for g in images]
    assert len(made) == 2  # one for each axis
    monkeypatch.setattr(ds, "KEPT", 0)
    for g, parts in zip(images, got, strict=True):
        for a, b in zip(parts, ds.describe(g, 3, 4, window_size=1.5, flat=True), strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert len(made) == 2 + 2 * 3

"""Colour conversion of columns with values 0 to 1, and small geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: linear RGB with the D65 white point to XYZ, and the white point itself
RGB_TO_XYZ = ((0.430574, 0.341550, 0.178325), (0.222015, 0.706655, 0.071330), (0.020183, 0.129553, 0.939180))
GRAY = (0.2989360213, 0.5870430745, 0.1140209043)
WHITE = (0.950456, 1.0, 1.088754)


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * GRAY[0] + g * GRAY[1] + b * GRAY[2]


def xyz(r: Column, g: Column, b: Column) -> list[Column]:
    return [r * a + g * c + b * d for a, c, d in RGB_TO_XYZ]


def lab(x: Column, y: Column, z: Column) -> list[Column]:
    """CIE L*a*b* of XYZ."""
    f = lambda t: F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * (29 / 6) ** 2 / 3 + 4 / 29)
    fx, fy, fz = f(x / WHITE[0]), f(y / WHITE[1]), f(z / WHITE[2])
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    part = F.nullif(d, F.lit(0.0))
    h = F.when(d == 0, 0.0).when(r == top, F.pmod((g - b) / part, F.lit(6.0))).when(g == top, (b - r) / part + 2).otherwise((r - g) / part + 4) / 6
    return [h, F.when(top == 0, 0.0).otherwise(d / F.nullif(top, F.lit(0.0))), top]


def rotation(x: Column, y: Column, z: Column) -> list[list[Column]]:
    """The rotation about the vector (x, y, z) by its length: the identity for the vector 0."""
    t = F.sqrt(x * x + y * y + z * z)
    one = F.nullif(t, F.lit(0.0))
    u = [F.coalesce(a / one, F.lit(0.0)) for a in (x, y, z)]
    s, c = F.sin(t), F.cos(t)
    cross = [[F.lit(0.0), -u[2], u[1]], [u[2], F.lit(0.0), -u[0]], [-u[1], u[0], F.lit(0.0)]]
    return [[(c if i == j else F.lit(0.0)) + (1 - c) * u[i] * u[j] + s * cross[i][j] for j in range(3)] for i in range(3)]


def affine(x: Column, y: Column, a: tuple[float, float, float, float], t: tuple[float, float]) -> list[Column]:
    return [x * a[0] + y * a[1] + t[0], x * a[2] + y * a[3] + t[1]]


def thin_plate(d2: Column) -> Column:
    """The basis r^2 ln r^2 of a squared distance; 0 at 0."""
    return F.when(d2 > 0, d2 * F.ln(F.greatest(d2, F.lit(1e-300)))).otherwise(0.0)


def rgb_of_xyz(x: Column, y: Column, z: Column) -> list[Column]:
    """The inverse of :func:`xyz`."""
    import numpy as np

    return [x * float(a) + y * float(b) + z * float(c) for a, b, c in np.linalg.inv(np.array(RGB_TO_XYZ))]


def luv(x: Column, y: Column, z: Column) -> list[Column]:
    """CIE L*u*v* of XYZ; 0 where there is no light."""
    total = F.nullif(x + 15 * y + 3 * z, F.lit(0.0))
    white = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    light = F.when(y > (6 / 29) ** 3, 116 * F.cbrt(y) - 16).otherwise(y * (29 / 3) ** 3)
    u = 13 * light * (4 * x / total - 4 * WHITE[0] / white)
    v = 13 * light * (9 * y / total - 9 * WHITE[1] / white)
    return [light, F.coalesce(u, F.lit(0.0)), F.coalesce(v, F.lit(0.0))]


def axis_angle(m: list[list[Column]]) -> list[Column]:
    """The vector whose :func:`rotation` is m, for angles below pi."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0][0] + m[1][1] + m[2][2] - 1) / 2))
    t = F.acos(cos)
    k = F.when(F.abs(F.sin(t)) < 1e-12, 0.5).otherwise(t / (2 * F.nullif(F.sin(t), F.lit(0.0))))
    return [k * (m[2][1] - m[1][2]), k * (m[0][2] - m[2][0]), k * (m[1][0] - m[0][1])]

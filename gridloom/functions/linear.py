"""Small linear systems and 2 x 2 decompositions, a row each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def solve2(m: list[Column], b: list[Column]) -> list[Column]:
    """x of the system with the matrix m (rows one after another); null where it is singular."""
    det = m[0] * m[3] - m[1] * m[2]
    safe = F.when(det != 0, det)
    return [(b[0] * m[3] - m[1] * b[1]) / safe, (m[0] * b[1] - b[0] * m[2]) / safe]


def _det3(m: list[Column]) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def solve3(m: list[Column], b: list[Column]) -> list[Column]:
    """As :func:`solve2`, for 3 x 3."""
    det = _det3(m)
    safe = F.when(det != 0, det)
    return [_det3([b[i // 3] if i % 3 == k else m[i] for i in range(9)]) / safe for k in range(3)]


def svd2(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """((a, b), (c, d)) = R(left) diag(s1, s2) R(right): R(t) turns by t; s1 >= |s2|."""
    e, f, g, h = (a + d) / 2, (a - d) / 2, (c + b) / 2, (c - b) / 2
    q, r = F.sqrt(e * e + h * h), F.sqrt(f * f + g * g)
    one, two = F.atan2(g, f), F.atan2(h, e)
    return {"s1": q + r, "s2": q - r, "left": (two + one) / 2, "right": (two - one) / 2}


def _stacked(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Solutions of systems (k, n, n) and (k, n); NaN where a matrix is singular."""
    try:
        return np.linalg.solve(a, v[..., None])[..., 0]
    except np.linalg.LinAlgError:  # some matrix is singular: the others go alone
        fit = np.abs(np.linalg.det(a)) > 0
        out = np.full(v.shape, np.nan)
        out[fit] = np.linalg.solve(a[fit], v[fit][..., None])[..., 0]
        return out


@F.pandas_udf(ArrayType(DoubleType()))
def solve(m: pd.Series, b: pd.Series) -> pd.Series:
    """x of m x = b; m: n * n numbers, rows one after another; null where m is singular or has a null. Systems of
    one size are solved together."""
    out = pd.Series([None] * len(m), index=m.index, dtype=object)
    sizes = b.map(lambda v: -1 if v is None else len(v))
    for n in sizes.unique():
        own = sizes.index[(sizes == n) & m.map(lambda a, n=n: a is not None and len(a) == n * n)]
        if n < 1 or not len(own):
            continue
        a, v = (np.array(s[own].tolist(), float) for s in (m, b))
        clean = np.isfinite(a).all(axis=1) & np.isfinite(v).all(axis=1)
        x = np.full(v.shape, np.nan)
        x[clean] = _stacked(a[clean].reshape(-1, n, n), v[clean])
        for i, row in zip(own, x, strict=True):
            out[i] = row.tolist() if np.isfinite(row).all() else None
    return out

"""Distances and kernels of pairs of ARRAY<DOUBLE> columns, as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column, y: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda a, b: a + b)


def _where_some(x: Column, y: Column, value: Column) -> Column:
    return F.when(x + y == 0, 0.0).otherwise(value)


def squared(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: (a - b) * (a - b))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(squared(x, y))


def l1(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: F.abs(a - b))


def linf(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def l0(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: F.when(a != b, 1.0).otherwise(0.0))


def chi2(x: Column, y: Column) -> Column:
    """Without the half; terms without weight are skipped."""
    return _sum(x, y, lambda a, b: _where_some(a, b, (a - b) * (a - b) / F.nullif(a + b, F.lit(0.0))))


def chi2_half(x: Column, y: Column) -> Column:
    """With the half, and a guard of 2**-52 in the denominator."""
    return _sum(x, y, lambda a, b: (a - b) * (a - b) / (a + b + F.lit(2.0**-52))) / 2


def hellinger(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: a + b - 2 * F.sqrt(a * b))


def _js(a: Column, b: Column) -> Column:
    return F.when(a == 0, 0.0).otherwise(a * F.log2(1 + b / F.nullif(a, F.lit(0.0))))


def jensen_shannon(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: a - _js(a, b) + b - _js(b, a))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda p, q: _sum(p, q, lambda a, b: a * b)
    return F.greatest(F.lit(0.0), 1 - dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def earth_mover(x: Column, y: Column) -> Column:
    """L1 of the running sums."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("out"))
    diff = F.zip_with(x, y, lambda a, b: a - b)
    return F.aggregate(diff, start, lambda s, d: F.struct((s["run"] + d).alias("run"), (s["out"] + F.abs(s["run"] + d)).alias("out")), lambda s: s["out"])


def mahalanobis(x: Column, mean: Column, inverse_variance: Column) -> Column:
    return F.aggregate(F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), inverse_variance, lambda d, s: d * s), F.lit(0.0), lambda a, b: a + b)


def kernel_l2(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: a * b)


def kernel_l1(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: (F.abs(a) + F.abs(b) - F.abs(a - b)) / 2)


def kernel_chi2(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: _where_some(a, b, 2 * a * b / F.nullif(a + b, F.lit(0.0))))


def kernel_hellinger(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: F.sqrt(a * b))


def kernel_js(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: (_js(a, b) + _js(b, a)) / 2)


METRICS = {
    "l2_squared": squared, "euclidean": euclidean, "l1": l1, "linf": linf, "l0": l0, "chi2": chi2, "chi2_half": chi2_half,
    "hellinger": hellinger, "js": jensen_shannon, "cosine": cosine, "emd": earth_mover,
    "kernel_l1": kernel_l1, "kernel_l2": kernel_l2, "kernel_chi2": kernel_chi2, "kernel_hellinger": kernel_hellinger, "kernel_js": kernel_js,
}

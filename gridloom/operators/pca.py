"""Principal components from sums over blocks.

A first pass sums the components, a second one the products of what is left after the means: a
d x d matrix a task, whose upper triangle Spark adds over tasks. Only that matrix reaches the driver,
so rows may be as many as one likes; d is bounded by ``MOST_COMPONENTS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import importable, lists, matrix

#: Largest d: a matrix of 4096 x 4096 doubles has 128 MB.
MOST_COMPONENTS = 4096


@dataclass(frozen=True)
class Basis:
    """mean (d), components (r, d) by falling variance, variances (r), and the number of rows."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    rows: int

    def shares(self) -> np.ndarray:
        """The part of all variance that the first 1, 2, ... components explain."""
        total = self.variances.sum()
        return np.cumsum(self.variances) / total if total > 0 else np.ones(len(self.variances))


def means(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of the rows (x), and the mean of each component."""
    long = rows.select(F.posexplode(F.col("x").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"))
    found = {r.i: r for r in long.collect()}  # d rows
    if len(found) > MOST_COMPONENTS:
        raise ValueError(f"{len(found)} components; at most {MOST_COMPONENTS}")
    if len({r.n for r in found.values()}) > 1:
        raise ValueError("vectors of different lengths")
    return (found[0].n if found else 0), np.array([found[i].m for i in range(len(found))])


def scatter(rows: DataFrame, mean: np.ndarray) -> DataFrame:
    """(i, j, s): sums of (x[i] - mean[i]) * (x[j] - mean[j]) over the rows (x), for i <= j."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width) - mean
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    importable(rows.sparkSession)
    parts = rows.select(F.col("x").cast("array<double>")).mapInArrow(run, "i int, j int, s double")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"))


def covariance(rows: DataFrame) -> DataFrame:
    """(i, j, v) for i <= j: covariances with n - 1; 0 of a single row."""
    n, mean = means(rows)
    return scatter(rows, mean).select("i", "j", (F.col("s") / max(n - 1, 1)).alias("v"))


def fit(rows: DataFrame, least: float = 1e-30) -> Basis:
    """The principal components of the rows (x) whose variance is over ``least``. Of the two directions of
    a component the one is given whose largest part (the first of equal ones) is positive. A single row has
    one component of zeros, with variance 0."""
    n, mean = means(rows)
    if n <= 1:
        return Basis(mean, np.zeros((n, len(mean))), np.zeros(n), n)
    full = np.zeros((len(mean), len(mean)))
    found = scatter(rows, mean).toArrow()
    i, j = np.asarray(found["i"]), np.asarray(found["j"])
    full[i, j] = full[j, i] = np.asarray(found["s"]) / (n - 1)
    variance, u = np.linalg.eigh(full)
    order = np.argsort(-variance, kind="stable")
    variance, u = variance[order], u[:, order].T
    u, variance = u[variance > least], variance[variance > least]
    sign = np.sign(u[np.arange(len(u)), np.abs(np.round(u, 12)).argmax(1)])
    return Basis(mean, u * sign[:, None], variance, n)


def apply(rows: DataFrame, basis: Basis, k: int) -> DataFrame:
    """(id, y, xhat, e, e0): coordinates along the first k components, the vector that they give back,
    and the squared lengths of what is lost and of the centred vector."""
    u, mean, width = basis.components[:k], basis.mean, len(basis.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width) - mean
            y = x @ u.T
            back = y @ u
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(y), lists(back + mean), pa.array(((x - back) ** 2).sum(1)), pa.array((x**2).sum(1))], names=["id", "y", "xhat", "e", "e0"])

    importable(rows.sparkSession)
    kind = dict(rows.dtypes)["id"]
    return rows.select("id", F.col("x").cast("array<double>")).mapInArrow(run, f"id {kind}, y array<double>, xhat array<double>, e double, e0 double")


def residual(rows: DataFrame, basis: Basis, k: int) -> float:
    """The share of the rows' variance that the first k components lose."""
    r = apply(rows, basis, k).agg(F.sum("e"), F.sum("e0")).first()
    return r[0] / r[1] if r[1] else 0.0


def random_vectors(spark, basis: Basis, k: int, n: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x): n vectors from the normal distribution of the first k components; with a radius other than
    0, from the surface of the ellipsoid that many deviations away."""
    u, spread, mean = basis.components[:k], np.sqrt(basis.variances[:k]), basis.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(u)) for i in ids]) if len(ids) else np.zeros((0, len(u)))
            if radius:
                z = radius * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), np.finfo(float).tiny)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists((z * spread) @ u + mean)], names=["id", "x"])

    importable(spark)
    return spark.range(n).mapInArrow(run, "id bigint, x array<double>")

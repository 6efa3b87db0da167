"""Linear machines trained by gradient steps or by dual coordinate ascent, distributed.

Data: (id, x: array<double>, y: 1 or -1 or a number). The model is (w, b); b is the weight of a
coordinate of value ``bias`` that is added to every row. Objective: lambda / 2 (|w|^2 + (b / bias)^2)
+ mean loss. The model has one number a dimension and lives on the driver between rounds.

Defined results: an empty table gives a model of zeros without dimensions; null vectors and labels
must be taken out by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import svm as fs
from .cluster import cut_lineage


@dataclass
class Model:
    w: list[float]
    b: float
    rounds: list[dict]


def inner_product(x: Column, w: list[float], b: float = 0.0, bias: float = 1.0) -> Column:
    """Score of a row: w x + b * bias."""
    total = F.lit(float(b) * bias)
    for i, v in enumerate(w):
        total = total + F.get(x, F.lit(i)) * F.lit(float(v))
    return total


def accumulated(x: Column, by: Column, dims: int) -> Column:
    """Sum over rows of by * x, an array: one partial sum a partition."""
    return F.array(*(F.sum(F.get(x, F.lit(i)) * by) for i in range(dims)))


def _dims(df: DataFrame) -> int:
    return df.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0


def evaluate(df: DataFrame, model: Model, loss: str, lam: float, bias: float = 1.0) -> dict:
    """Number of rows, mean loss and objective."""
    s = inner_product(F.col("x"), model.w, model.b, bias)
    n, mean = df.agg(F.count(F.lit(1)), F.avg(fs.loss(loss, s, F.col("y")))).first()
    own = lam / 2 * (sum(v * v for v in model.w) + model.b**2)
    return {"rows": n, "loss": mean or 0.0, "objective": own + (mean or 0.0)}


def gradient_descent(df: DataFrame, loss: str = "hinge", lam: float = 0.01, epochs: int = 10, bias: float = 1.0, start: float = 1.0) -> Model:
    """Steps of length 1 / (lam (t + start)) against the full gradient; one pass of the data a step."""
    dims = _dims(df)
    model = Model([0.0] * dims, 0.0, [])
    for t in range(epochs):
        s = inner_product(F.col("x"), model.w, model.b, bias)
        by = fs.derivative(loss, s, F.col("y"))
        row = df.select("x", by.alias("by"), fs.loss(loss, s, F.col("y")).alias("loss")).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.sum("by").alias("b"), accumulated(F.col("x"), F.col("by"), dims).alias("g")).first()
        if not row.n:
            break
        model.rounds.append({"round": t, "objective": lam / 2 * (sum(v * v for v in model.w) + model.b**2) + row.loss})
        rate = 1 / (lam * (t + start))
        model.w = [v - rate * (lam * v + g / row.n) for v, g in zip(model.w, row.g, strict=True)]
        model.b -= rate * (lam * model.b + bias * row.b / row.n)
    return model


def dual_ascent(df: DataFrame, loss: str = "hinge", lam: float = 0.01, epochs: int = 10, bias: float = 1.0, gap: float = 1e-3) -> Model:
    """Stochastic dual coordinate ascent: each partition visits its rows, a batch after another, in an
    order that depends on the round, on a model of its own; changes of the dual values are averaged
    over the partitions. Ends when the duality gap is below gap. The rows are checkpointed each round,
    with their dual values."""
    dims, n = _dims(df), df.count()
    model = Model([0.0] * dims, 0.0, [])
    if not n:
        return model
    data = cut_lineage(df.select("x", F.col("y").cast("double").alias("y"), F.lit(0.0).alias("alpha")))
    parts = data.rdd.getNumPartitions()
    whole = np.zeros(dims + 1)
    for t in range(epochs):
        data = cut_lineage(data.mapInArrow(_visit(loss, lam * n, t, bias, whole, parts), data.schema))
        # the model is linear in the dual values
        sums = data.agg(accumulated(F.col("x"), F.col("alpha"), dims).alias("g"), F.sum("alpha").alias("b")).first()
        whole = np.array([*sums.g, bias * sums.b]) / (lam * n)
        model.w, model.b = whole[:-1].tolist(), float(whole[-1])
        objective = evaluate(data, model, loss, lam, bias)["objective"]
        dual = data.agg(F.avg(-fs.conjugate(loss, -F.col("alpha"), F.col("y")))).first()[0] - lam / 2 * float(whole @ whole)
        model.rounds.append({"round": t, "objective": objective, "dual": dual, "gap": objective - dual})
        if objective - dual < gap:
            break
    return model


def _visit(loss: str, lam_n: float, t: int, bias: float, whole: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = whole.copy()
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = np.concatenate((np.asarray(batch.column(0).flatten()).reshape(rows, -1), np.full((rows, 1), bias)), axis=1)
            y, old = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            alpha = old.copy()
            norms = (x * x).sum(axis=1) / lam_n
            for i in np.random.default_rng(t).permutation(rows):
                if norms[i] > 0:
                    step = dual_step(loss, alpha[i], float(w @ x[i]), norms[i], y[i])
                    alpha[i] += step
                    w += step / lam_n * x[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(old + (alpha - old) / parts)], names=["x", "y", "alpha"])

    return run


def dual_step(loss: str, alpha: float, inner: float, norm2: float, label: float) -> float:
    """As :func:`gridloom.functions.svm.dual_step`, of one row."""
    full, soft = (label - inner) / norm2 + alpha, (label - inner - alpha / 2) / (norm2 + 0.5)
    if loss == "hinge":
        return label * min(1.0, max(0.0, label * full)) - alpha
    if loss == "hinge2":
        return label * max(0.0, label * (soft + alpha)) - alpha
    if loss == "l1":
        return min(1.0, max(-1.0, full)) - alpha
    if loss == "l2":
        return soft
    lo, hi = 0.0, 1.0
    for _ in range(fs.HALVINGS):
        mid = (lo + hi) / 2
        if -np.log(mid / (1 - mid)) - label * inner - norm2 * (mid - label * alpha) > 0:
            lo = mid
        else:
            hi = mid
    return label * (lo + hi) / 2 - alpha


def train(df: DataFrame, solver: str = "sdca", **options) -> Model:
    """solver: "sdca" or "sgd"."""
    return {"sdca": dual_ascent, "sgd": gradient_descent}[solver](df, **options)

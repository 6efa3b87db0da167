"""What Python tasks need: the package itself, and matrices of list columns."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for functions that refer to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="gridloom-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(path)  # kept by the driver's file server
    _shipped.add(sc.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over four tasks a core, however few bytes it has: for work in Python, which takes long a byte."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; null and missing components are NaN."""
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    if not column.null_count and len(flat) == len(column) * width and (np.diff(np.asarray(column.offsets)) == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(column), width), np.nan)
    for i, x in enumerate(column.to_pylist()):
        x = [np.nan if v is None else v for v in x or []][:width]
        out[i, : len(x)] = x
    return out


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))

"""Nearest neighbours of a set of queries among all rows.

Queries go out in blocks of bounded size; each partition keeps its own k nearest of each query, so
a query's rows that meet in one task are k times the partitions, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries compared with all rows in one pass.
BLOCK = 2048


def top_k(queries: DataFrame, base: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """(query, id, distance, place): the k rows of base (id, x) least in squared distance from each
    query (id, x); ties by id. Places start at 1."""
    out = None
    ids = queries.select("id", "x").orderBy("id")
    last = None
    while True:
        part = ids if last is None else ids.where(F.col("id") > last)
        block = part.limit(BLOCK).collect()
        if not block and out is not None:
            break
        found = _pass(block, base, k, skip_self)
        out = found if out is None else out.unionByName(found)
        if len(block) < BLOCK:
            break
        last = block[-1].id
    w = Window.partitionBy("query").orderBy("distance", "id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _pass(block: list, base: DataFrame, k: int, skip_self: bool) -> DataFrame:
    if not block:
        return base.sparkSession.createDataFrame([], "query bigint, id bigint, distance double")
    names = np.array([r.id for r in block], np.int64)
    q = np.array([r.x for r in block], np.float64).reshape(len(block), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_i = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64)
            for a in range(0, len(ids), 512):
                part = x[a : a + 512]
                d = ((q[:, None, :] - part[None, :, :]) ** 2).sum(axis=2) if len(q) * len(part) * q.shape[1] < 4e7 else np.stack([((part - v) ** 2).sum(axis=1) for v in q])
                near = np.broadcast_to(ids[a : a + 512], d.shape)
                if skip_self:
                    d = np.where(near == names[:, None], np.inf, d)
                d, near = np.concatenate((best_d, d), axis=1), np.concatenate((best_i, near), axis=1)
                order = np.lexsort((near, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)
        ok = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_d.shape[1])[ok.ravel()]), pa.array(best_i[ok]), pa.array(best_d[ok])], names=["query", "id", "distance"])

    return base.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "query bigint, id bigint, distance double")


def ratio_match(queries: DataFrame, base: DataFrame, factor: float) -> DataFrame:
    """(query, id, distance): the nearest row, if factor * its distance is under the second one's.
    A single candidate matches."""
    two = top_k(queries, base, 2).groupBy("query").agg(F.min(F.struct("place", "id", "distance")).alias("first"), F.max(F.when(F.col("place") == 2, F.col("distance"))).alias("second"))
    keep = F.col("second").isNull() | (factor * F.col("first.distance") < F.col("second"))
    return two.where(keep).select("query", F.col("first.id").alias("id"), F.col("first.distance").alias("distance"))


def nearest_centre(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, k, distance): the centre (k, c) least in squared distance from each row (id, x); ties by k.

    Centres are few by definition (a parameter of the clustering), so they are sent to all tasks.
    """
    from .metrics import squared

    both = rows.select("id", "x").join(F.broadcast(centres.select("k", "c")), F.lit(True))
    best = both.select("id", F.struct(squared(F.col("x"), F.col("c")).alias("d"), F.col("k")).alias("b")).groupBy("id").agg(F.min("b").alias("b"))
    return best.select("id", F.col("b.k").alias("k"), F.col("b.d").alias("distance"))


def with_nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with k and distance of :func:`nearest_centre`, found where each row is, without a shuffle."""
    from .metrics import squared

    few = centres.agg(F.collect_list(F.struct("k", "c")).alias("_all"))  # one row: the centres
    best = F.array_min(F.transform("_all", lambda s: F.struct(squared(F.col("x"), s["c"]).alias("d"), s["k"].alias("k"))))
    return rows.crossJoin(F.broadcast(few)).withColumn("_best", best).withColumn("k", F.col("_best.k")).withColumn("distance", F.col("_best.d")).drop("_all", "_best")

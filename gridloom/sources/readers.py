"""Sources: key-point files, gray images, box annotations, frame containers, class folders.

Files are read by Spark (text or binaryFile), so any store it reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SCHEMA = "path string, key int, y double, x double, scale double, angle double, descriptor array<int>"


def key_points(spark: SparkSession, path: str) -> DataFrame:
    """Key-point text files: the number of points and of descriptor values, then for each point row,
    column, scale, angle, and its values, in any line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.array(raw.split(), float)
                if len(v) < 2:
                    continue
                n, d = int(v[0]), int(v[1])
                rows = v[2 : 2 + n * (d + 4)].reshape(n, d + 4)
                cols = [pa.array([name] * n), pa.array(np.arange(n), pa.int32()), *(pa.array(rows[:, k]) for k in range(4)), pa.array(list(rows[:, 4:].astype(np.int32)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "key", "y", "x", "scale", "angle", "descriptor"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, KEY_SCHEMA)


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """PGM files (plain P2 or raw P5, up to 16 bits) as cells (path, r, c, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = decode_pgm(raw)
                r, c = np.indices(v.shape)
                yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(v.ravel().astype(float))], names=["path", "r", "c", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, r int, c int, v double")


def decode_pgm(raw: bytes) -> np.ndarray:
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    kind, width, height, top = fields[0], *map(int, fields[1:])
    if kind == b"P2":
        return np.array(raw[at:].split(), np.int64).reshape(height, width)
    if kind != b"P5":
        raise ValueError(f"not a gray map: {kind!r}")
    return np.frombuffer(raw, ">u2" if top > 255 else np.uint8, width * height, at + 1).reshape(height, width)


def box_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Box annotation text, version 3: a first line with %, then for each object label, x, y, w, h,
    occluded, the visible part's x, y, w, h, ignore, angle."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("f")).where((F.size("f") >= 12) & ~F.get("f", F.lit(0)).startswith("%"))
    number = lambda k, t: F.get("f", F.lit(k)).cast(t)
    names = ("x", "y", "w", "h"), ("vx", "vy", "vw", "vh")
    return lines.select("path", F.get("f", F.lit(0)).alias("lbl"), *(number(1 + k, "double").alias(n) for k, n in enumerate(names[0])), (number(5, "int") == 1).alias("occluded"), *(number(6 + k, "double").alias(n) for k, n in enumerate(names[1])), (number(10, "int") == 1).alias("ignore"), number(11, "double").alias("angle"))


def class_folders(spark: SparkSession, path: str, train: int, seed: int = 0) -> DataFrame:
    """(path, cls, part): the files below path/<class>/, train of each class (by hash) as 'train'."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.withColumn("cls", F.element_at(F.split("path", "/"), -2))
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.xxhash64("path", F.lit(seed)), "path"))
    return files.select("path", "cls", F.when(place <= train, "train").otherwise("test").alias("part"))


def write_frames(df: DataFrame, path: str) -> None:
    """Frames (stream, frame, ts, bytes) as Parquet, sorted within each stream."""
    df.repartition("stream").sortWithinPartitions("stream", "frame").write.partitionBy("stream").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""Helpers shared by the corpus operators: inputs, shared work folders, schemas."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Spark's setting: shuffle files are removed when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The ASCII white space that the contracts name: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was started in another folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all nodes share.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a
    lost executor only costs its running tasks. Its shuffle files go with the end of the write, not whenever the
    driver collects its garbage. by: a column of whole numbers by which files lie in folders."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}-{name}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialised DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0].split("/_gl_part=")[0] for f in df.inputFiles()}:
        if "/gridloom-" in path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_of(column: str = "text"):
    """The text column, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def few_rows(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than is needed to tell."""
    return df.limit(limit + 1).count() <= limit

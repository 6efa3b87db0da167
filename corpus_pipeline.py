"""The corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage works on all documents that the one before kept. Stages but the last return the columns
of documents; a stage that changes texts brings n_chars up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, ngram_join, packing, suffix_dedup, toxicity
from gridloom.llm._common import documents, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network of operator 10 scores under 0.5."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, net)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 9)."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at similarity 0.8 over five-word shingles (operator 1)."""
    return ngram_join.drop_near_copies(docs)


#: Bytes of a repeated string that the stage takes out: less than any 50 words have.
PASSAGE = 200


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of PASSAGE bytes that start more than once (operator 8)."""
    out = suffix_dedup.drop_repeats(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids (operator 6)."""
    return packing.pack(docs, packing.byte_vocabulary()).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("packing", pack),
]

#: SQL can't express the network, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

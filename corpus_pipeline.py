"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes what the one before kept. The first four return the columns of ``documents``; the last one,
the pieces of packed windows. ``run`` writes every stage's result as Parquet to the shared folder of
``spark.checkpoint.dir`` and reads it again, so a lost executor costs at most one stage's tasks. The folder stays until
whoever reads the result is done with it; it is named after no other run's.

Cases: a null text is an empty one; rows without id go through every stage and are never copies of others; rows
of one id are judged each by itself, but count as one document among near duplicates; without usable labels all
documents stay in the first stage, with an empty benchmark in the fourth; an empty table gives no piece; columns
beside those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneload.llm import decontaminate, minhash, packing, quality, suffix
from zoneload.llm._util import crc_mod, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    return _columns(quality.accepted(docs, model))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    return _columns(minhash.distinct_documents(docs))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that an earlier document has; n_chars follows."""
    return _columns(suffix.trimmed(docs)).withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a test item."""
    return _columns(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained scores, tokenisation and packing can't be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

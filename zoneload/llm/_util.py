"""Session plumbing shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, shared_folder  # noqa: F401


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: str, by: int) -> Column:
    """crc32 of a column's text form, modulo ``by`` (null for a null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes the number of groups, so that each stays bounded."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def groups_for(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_by(df: DataFrame, key: str, groups: int, each: int = 8) -> DataFrame:
    """``df`` ready to be grouped by ``key``, which has ``groups`` values: where the session's number of shuffle
    partitions would give a task more than ``each`` groups, it is shuffled here into as many partitions as needed."""
    needed = math.ceil(groups / each)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(needed, key) if needed > usual else df

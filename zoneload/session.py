"""Sessions, and what a session needs before the package's functions run on its executors."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(name: str = "zoneload", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, which removes checkpoints that nothing refers to any more; ``conf`` keys use
    _ for the dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, also where the session began before it was imported."""
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of this machine
    serves a local session; on a cluster it would be the driver's alone, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def dealt(rows: DataFrame, count: int, keys: Sequence[str], size: int) -> DataFrame:
    """``rows`` (so many) dealt by ``keys`` to partitions of about ``size`` rows, however many the session's setting has: what
    is then grouped by these keys and others stays in its partition, so a task's memory doesn't grow with the input."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, math.ceil(count / size), min(usual, math.ceil(count / 10_000))), *keys)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut a plan's lineage by writing it to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path that the driver and all executors see."""
    return f"{shared_base(spark)}/zoneload-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder by columns, for several readers that take different ones."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)

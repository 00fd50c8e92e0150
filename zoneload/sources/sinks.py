"""Writers of canonical series, control tables, schedules, review packets and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pricing import compared
from ..operators import features as A
from ..operators import prepare as P
from .readers import flat_calls, flat_windows


def write_canonical(series: DataFrame, path: str, dataset: str) -> None:
    """Series by dataset, and its price-change reference beside it; writing again replaces that dataset only."""
    options = {"partitionOverwriteMode": "dynamic"}
    series.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").options(**options).partitionBy("dataset").parquet(f"{path}/series")
    A.price_reference(A.price_changes(series)).withColumn("dataset", F.lit(dataset)).write.mode("overwrite").options(**options).partitionBy("dataset").parquet(f"{path}/price_reference")


def read_canonical(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A dataset's series, validated."""
    return P.validated(spark.read.parquet(f"{path}/series").where(F.col("dataset") == dataset).drop("dataset"))


def control_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of nested control results."""
    keys = ["run"]
    calls = flat_calls(results, keys)
    zones = results.select("run", "attempts_used", "status", F.explode_outer("zones").alias("z"))
    return {
        "final_windows": flat_windows(results, keys, "final"),
        "attempt_trace": flat_windows(results, keys, "attempts"),
        "attempt_usage": calls.groupBy("run", "zone_id", "attempt").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")),
        "step_usage": calls.groupBy("run", "agent").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens")),
        "run_summary": zones.groupBy("run", "status", "attempts_used").agg(F.count("z").alias("zones"), F.count_if(F.col("z.status") == "success").alias("succeeded")),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Each table that has rows, as Parquet below ``path``; nested columns become JSON text. Returns the names written."""
    done = []
    for name, table in tables.items():
        nested = [f.name for f in table.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        flat = table.withColumns({c: F.to_json(c) for c in nested})
        if not flat.isEmpty():
            flat.write.mode("overwrite").parquet(f"{path}/{name}")
            done.append(name)
    return done


def price_schedule(windows: DataFrame) -> DataFrame:
    """One row per hour of each window, with its price, and how it compares with the baseline's."""
    hours = windows.withColumn("timestamp", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 hour"))))
    return hours.withColumns(compared(F.col("proposed_energy_price"), F.col("mean_energy_price")))


def review_packet(zones: DataFrame, windows: DataFrame, raters: int = 1) -> DataFrame:
    """Zone rows and window rows in one table, with empty columns for raters."""
    both = zones.withColumn("row_type", F.lit("zone")).unionByName(windows.withColumn("row_type", F.lit("window")), allowMissingColumns=True)
    return both.withColumns({f"rater_{i + 1}_{field}": F.lit(None).cast("string") for i in range(raters) for field in ("score", "comment")})

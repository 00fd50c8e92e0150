"""Exact quantiles without gathering a column in one task: selection by rank over ranges of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def quantiles(rows: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """name, total, fraction, value: linearly interpolated quantiles of the columns' values that aren't null, one row per
    column with any value and fraction. All columns and fractions share the passes."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    counts = rows.select(F.inline(F.array(*pairs))).where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    return quantiles_of_counts(counts, fractions)


def quantiles_of_counts(counts: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """As ``quantiles``, from distinct (name, value) with their counts ``n``.

    Values are dealt to partitions by range. The partitions' sums, a row each, tell which of them hold the asked ranks;
    only these are sorted, and each holds what a range has, however many rows there are or how often a value occurs.
    """
    dealt = checkpoint(counts.select("name", "value", "n").repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("name", "part").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("name")
    parts = sums.select("name", "part", "n", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    place = lambda f: F.lit(float(f)) * (F.col("total") - 1)
    asked = [F.struct(F.lit(float(f)).alias("fraction"), place(f).alias("at"), side(place(f)).cast("long").alias("rank")) for f in fractions for side in (F.floor, F.ceil)]
    wanted = parts.select("*", F.inline(F.array(*asked))).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n")
    # Two rows per name and fraction.
    wanted = checkpoint(wanted)
    held = dealt.join(F.broadcast(wanted.select("name", "part").distinct()), ["name", "part"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("name", "part").orderBy("value"))
    rank = F.col("rank") - F.col("before")
    found = held.withColumn("upto", upto).join(F.broadcast(wanted), ["name", "part"]).where((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")))
    ends = found.groupBy("name", "total", "fraction", "at").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("name", "total", "fraction", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("at") - F.floor("at")) * (F.col("high") - F.col("low"))).alias("value"))

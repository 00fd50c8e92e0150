"""Intervals and points in time: merging, and which points lie in any interval, without a task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Stand for open ends.
ALWAYS, NEVER = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, current: bool = True) -> DataFrame:
    """``rows`` with the largest ``value`` of their key's rows up to their own place in ``order`` (equal places included, a
    range never cuts between them), or before it (places differ then).

    Rows are dealt to partitions by ranges of key and order, so a key with most rows has many tasks; what earlier
    partitions hand on is a row per partition and key there.
    """
    dealt = checkpoint(rows.withColumn("__value", value).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    tails = dealt.groupBy("__part", *keys).agg(F.max("__value").alias("__tail"))
    before = F.max("__tail").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = tails.select("__part", *keys, before.alias("__carried"))
    window = Window.partitionBy("__part", *keys).orderBy(*order)
    local = F.max("__value").over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow) if current else window.rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = dealt.withColumn("__local", local).alias("d").join(carried.alias("c"), [F.col("d.__part") == F.col("c.__part"), *same], "left")
    return joined.select("d.*", F.greatest("d.__local", "c.__carried").alias(name)).drop("__value", "__part", "__local")


def _closed(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals with open ends filled in; empty and backward ones go."""
    start, end = (F.coalesce(F.col(c).cast("timestamp_ntz"), F.lit(edge).cast("timestamp_ntz")) for c, edge in (("start", ALWAYS), ("end", NEVER)))
    return intervals.select(*keys, start.alias("start"), end.alias("end")).where("start < end")


def merged(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: ``[start, end)`` intervals that overlap or touch as one; a null end is open, in and out.

    An interval begins a new one if no earlier of its key reaches it; the others' ends count for the last beginning
    before them, which the running maximum of beginnings tells.
    """
    rows = _closed(intervals, keys).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    reached = running_max(rows, keys, ["start"], F.col("end"), "__reach", current=False)
    begins = F.when(F.coalesce(F.col("start") > F.col("__reach"), F.lit(True)), F.col("start"))
    groups = running_max(reached.withColumn("__begin", begins).drop("__reach"), keys, ["start"], F.col("__begin"), "__from")
    ends = groups.groupBy(*keys, F.col("__from").alias("start")).agg(F.max("end").alias("end"))
    return ends.select(*keys, *[F.when(F.col(c) != F.lit(edge).cast("timestamp_ntz"), F.col(c)).alias(c) for c, edge in (("start", ALWAYS), ("end", NEVER))])


def covered(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, inside: bool = True) -> DataFrame:
    """The rows whose ``time`` lies in some ``[start, end)`` interval of their key, or (``inside=False``) in none. Repeated rows
    stay as they are; rows without key or time lie in none.

    Points and beginnings are merged in one order: a point is covered if the largest end of the intervals that began by
    then is after it. So no row meets an interval, however many, long or overlapping they are.
    """
    names = rows.columns
    point = F.struct(*names)
    spans = _closed(intervals, keys).groupBy(*keys, "start").agg(F.max("end").alias("__end"))
    whole = F.col(time).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    events = rows.where(whole).select(*keys, F.col(time).cast("timestamp_ntz").alias("__at"), F.lit(1).alias("__kind"), point.alias("__row"), F.lit(None).cast("timestamp_ntz").alias("__end"))
    starts = spans.select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.select(point.alias("r")).schema["r"].dataType).alias("__row"), "__end")
    reach = running_max(events.unionByName(starts), keys, ["__at", "__kind"], F.col("__end"), "__reach")
    fine = F.coalesce(F.col("__reach") > F.col("__at"), F.lit(False))
    got = reach.where((F.col("__kind") == 1) & (fine if inside else ~fine)).select("__row.*")
    return got if inside else got.unionByName(rows.where(~whole))

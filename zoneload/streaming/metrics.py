"""Summaries of scraped metric series: gauges, counters with resets and missed scrapes, histograms' means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series_summary(samples: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Per series over scrapes ``first`` to ``last``: gauge statistics, and as a counter the delta.

    A fall against the scrape before, missed ones in between or not, is a reset. ``known_delta`` sums the differences of
    adjacent scrapes that don't fall; it is null without any. ``delta`` needs every scrape and no reset.
    """
    w = Window.partitionBy(*keys).orderBy("scrape_index")
    adjacent = F.col("scrape_index") == F.lag("scrape_index").over(w) + 1
    step = F.col("value") - F.lag("value").over(w)
    rows = samples.withColumns({"reset": F.coalesce(step < 0, F.lit(False)), "step": F.when(adjacent & (step >= 0), step)})
    got = rows.groupBy(*keys).agg(
        F.count("value").alias("samples"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.sum("step").alias("known_delta"), F.count_if("reset").alias("resets"), F.count_distinct("scrape_index").alias("scrapes"),
        F.min_by("value", "scrape_index").alias("a"), F.max_by("value", "scrape_index").alias("b"),
    )
    whole = (F.col("samples") == last - first + 1) & (F.col("scrapes") == last - first + 1) & (F.col("resets") == 0)
    return got.withColumn("delta", F.when(whole, F.col("b") - F.col("a"))).drop("a", "b")


def histogram_means(sums: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delta of the sum over delta of the count; null unless both are complete."""
    both = sums.select(*keys, F.col("delta").alias("ds")).join(counts.select(*keys, F.col("delta").alias("dc")), list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("dc") > 0, F.try_divide("ds", "dc")).alias("mean"))

"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import checkpoint


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes in ``links`` (a, b).

    Each round a node takes the smallest label of itself and its neighbours, then its label's label, so that
    labels travel along chains in steps that double. Minima are aggregated before the shuffle; nothing is
    collected. Null ends are left out; without links the result is empty.
    """
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = checkpoint(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = checkpoint(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        moved = checkpoint(better.join(jump, "label", "left").select("node", F.least("label", "further").alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels

"""Exact quantiles over ranges against DuckDB's, with ties, nulls and few rows per partition."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from zoneload.operators.features import percentile_of, price_reference
from zoneload.operators.quantiles import quantiles

FRACTIONS = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]


def rows_of(seed, n):
    r = random.Random(seed)
    hot = r.choice([1.5, -2.0])
    return [(hot if r.random() < 0.4 else r.gauss(0, 100), None if r.random() < 0.3 else float(r.randint(0, 4)), r.random() if r.random() < 0.01 else None) for _ in range(n)]


@pytest.mark.parametrize("seed,n,ranges", [(1, 1, 5), (2, 2, 5), (3, 7, 13), (4, 500, 13), (5, 500, 1), (6, 3000, 40)])
def test_quantiles_equal_duckdb(spark, seed, n, ranges):
    rows = rows_of(seed, n)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["name"], r["fraction"]): (r["value"], r["total"]) for r in quantiles(spark.createDataFrame(rows, "a double, b double, `c d` double"), ["a", "b", "c d"], FRACTIONS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (a DOUBLE, b DOUBLE, c DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    for name, column in (("a", "a"), ("b", "b"), ("c d", "c")):
        for f in FRACTIONS:
            want, total = duck.execute(f"SELECT quantile_cont({column}, {f}), count({column}) FROM t").fetchone()
            if total:
                assert got[name, f] == (pytest.approx(want, abs=1e-9), total)
            else:
                assert (name, f) not in got


def test_reference_of_nothing_and_of_ties(spark):
    empty = spark.createDataFrame([], "change_pct double")
    assert tuple(price_reference(empty).first()) == (None, None, 0)
    asked = spark.createDataFrame([(-5.0,), (0.0,), (None,)], "shift double")
    assert all(r["percentile"] is None and r["exceeds_p95"] is None for r in percentile_of(asked, "shift", empty).collect())
    ties = spark.createDataFrame([(5.0,)] * 90 + [(0.0,)] * 10, "change_pct double")
    assert tuple(price_reference(ties).first()) == (5.0, 100, 90)
    assert {(r["shift"], r["percentile"], r["exceeds_p95"]) for r in percentile_of(asked.where(F.col("shift").isNotNull()), "shift", ties).collect()} == {(-5.0, 100.0, False), (0.0, 10.0, False)}


def test_no_percentile_buffer_in_the_plan(spark):
    """Ranks are taken from sums of ranges: no task holds a column's values."""
    plan = quantiles(spark.range(100).select(F.col("id").cast("double").alias("v")), ["v"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()

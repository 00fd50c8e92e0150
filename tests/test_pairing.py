"""Pairing evidence: what makes a run unready, and hashes that don't depend on order or partitions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from zoneload.operators.pairing import content_signature, content_sums, pairing_evidence

WINDOW = "run long, zone_id string, window_start timestamp_ntz, window_end timestamp_ntz"
DAY = datetime(2024, 1, 1)


def at(hour):
    return DAY + timedelta(hours=hour)


def tables(spark, change=lambda name, rows: rows):
    """Two zones of two windows for runs 1 (as given) and 2 (changed); ``change`` edits a table's rows of run 2."""
    windows = [(z, at(3 * i), at(3 * i + 2)) for z in ("001", "b") for i in range(2)]
    base = {
        "windows": [(*w, 0.5, 10.0, "Medium") for w in windows], "expected": windows, "thresholds": [(z, 1.0, 9.0) for z in ("001", "b")],
        "hourly": [(z, a + timedelta(hours=i), 1.0, 2.0, 0.5) for z, a, _ in windows for i in range(3)], "parameters": [({"alpha": "1", "days": "7"},)],
    }
    schemas = {
        "windows": WINDOW + ", mean_energy_price double, sum_predicted_kwh double, load_stress_level string", "expected": WINDOW, "thresholds": "run long, zone_id string, low_medium_kwh double, medium_high_kwh double",
        "hourly": "run long, zone_id string, time timestamp_ntz, actual_kwh double, predicted_kwh double, e_price double", "parameters": "run long, parameters map<string,string>",
    }
    return [spark.createDataFrame([(1, *r) for r in rows] + [(2, *r) for r in change(name, list(rows))], schemas[name]).repartition(3) for name, rows in base.items()]


def evidence(spark, change=lambda name, rows: rows):
    got = {r.run: r for r in pairing_evidence(*tables(spark, change), ["e_price"]).collect()}
    assert got[1].complete and got[1].pairing_ready and got[1].zones == 2
    return got[1], got[2]


def edit(table, f):
    return lambda name, rows: f(rows) if name == table else rows


def test_order_and_partitions_do_not_matter(spark):
    one, two = evidence(spark, lambda name, rows: rows[::-1])
    assert two.pairing_ready and one[2:] == two[2:]
    turned = edit("parameters", lambda _: [({"days": "7", "alpha": "1"},)])
    assert evidence(spark, turned)[1].parameters_signature == one.parameters_signature


@pytest.mark.parametrize("change", [
    edit("windows", lambda r: r[1:]), edit("windows", lambda r: r + r[:1]), edit("windows", lambda r: [(*r[0][:3], None, *r[0][4:]), *r[1:]]), edit("windows", lambda r: [(*r[0][:5], "medium"), *r[1:]]), edit("windows", lambda r: [(*r[0][:4], float("nan"), "Low"), *r[1:]]),
    edit("windows", lambda r: [("c", *r[0][1:]), *r]), edit("expected", lambda r: [*r, (r[0][0], at(30), at(32))]), edit("expected", lambda r: []), edit("thresholds", lambda r: r[1:]), edit("thresholds", lambda r: [(r[0][0], -1.0, 9.0), r[1]]),
    lambda name, rows: [(z, a, at(3) if a == at(0) else b, *rest) for z, a, b, *rest in rows] if name in ("windows", "expected") else rows,
])
def test_incomplete_windows(spark, change):
    """A missing, extra or repeated window, an unknown value, missing thresholds, an hour in two windows."""
    two = evidence(spark, change)[1]
    assert not two.complete and not two.pairing_ready and two.baseline_signature is None


@pytest.mark.parametrize("change", [edit("hourly", lambda r: r[1:]), edit("hourly", lambda r: r + r[:1]), edit("hourly", lambda r: [*r, ("b", at(99), 1.0, 2.0, 0.5)]), edit("hourly", lambda r: [(*r[0][:2], None, 2.0, 0.5), *r[1:]]), edit("hourly", lambda r: [])])
def test_uncovered_hours(spark, change):
    two = evidence(spark, change)[1]
    assert two.complete and two.hourly_signature is None and not two.pairing_ready


def test_other_content_gives_other_hashes(spark):
    one, two = evidence(spark, edit("hourly", lambda r: [(*r[0][:4], 0.6), *r[1:]]))
    assert two.pairing_ready and two.hourly_signature != one.hourly_signature and two.baseline_signature == one.baseline_signature
    one, two = evidence(spark, edit("windows", lambda r: [(*r[0][:3], 0.6, *r[0][4:]), *r[1:]]))
    assert two.pairing_ready and two.baseline_signature != one.baseline_signature and two.hourly_signature == one.hourly_signature
    assert not evidence(spark, edit("parameters", lambda _: [({},)]))[1].pairing_ready


def test_sums_count_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "a")], "g int, v string")
    got = {r.g: r.s for r in rows.groupBy("g").agg(*content_sums(F.col("v"))).select("g", content_signature().alias("s")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_runs_that_are_dealt_do_not_move_again(spark, tmp_path):
    """Before, each of some ten groupings and joins of a run's hours and windows shuffled them again."""
    from zoneload.catalog.evaluate import evidence

    rows = spark.range(30_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    got = evidence(spark, str(tmp_path))
    assert got.count() == 30_000
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("hashpartitioning(run#" in line and "REPARTITION_BY_NUM" in line for line in dealt)

"""The pooled model against numpy's dense solution and a plain recursion."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneload.plans import pooled as M

DAY = datetime(2024, 1, 1)
SERIES = "zone_id string, timestamp timestamp_ntz, load_kwh double, energy_price double, district string, tariff string"


def made_up(hours=90, zones=5):
    """Districts hold whole zones, tariffs cross them."""
    r = np.random.default_rng(3)
    rows = []
    for z in range(zones):
        for h in range(hours):
            load = None if r.random() < 0.03 else float(10 + 3 * z + 4 * math.sin(h / 4) + r.normal())
            rows.append((f"z{z}", DAY + timedelta(hours=h), load, None if r.random() < 0.05 else float(r.random()), "north" if z < 2 else "south", ["day", "night", None][int(r.integers(3))]))
    return rows


def vector(t, price, lag_1, lag_24):
    a, b = 2 * math.pi * t.hour / 24, 2 * math.pi * t.weekday() / 7
    return [1.0, lag_1, lag_24, math.sin(a), math.cos(a), math.sin(b), math.cos(b), price or 0.0]


def dense(rows, penalty):
    by_zone = {}
    for row in rows:
        by_zone.setdefault(row[0], []).append(row)
    zones, keys, x, y = sorted(by_zone), sorted({f"district={r[4]}" for r in rows} | {f"tariff={r[5] or ''}" for r in rows}), [], []
    for z, own in by_zone.items():
        for i in range(24, len(own)):
            if None not in (own[i][2], own[i - 1][2], own[i - 24][2]):
                has = {f"district={own[i][4]}", f"tariff={own[i][5] or ''}"}
                x.append(vector(own[i][1], own[i][3], own[i - 1][2], own[i - 24][2]) + [float(z == k) for k in zones] + [float(k in has) for k in keys])
                y.append(own[i][2])
    x, ridge = np.array(x), np.eye(len(x[0])) * penalty
    ridge[0, 0] = 1e-9
    return np.linalg.solve(x.T @ x + ridge, x.T @ np.array(y)), zones, keys


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_solution_equals_the_dense_one(spark, monkeypatch, local):
    rows = made_up(60, 3) if not local else made_up()
    monkeypatch.setattr(M, "LOCAL_ENTRIES", local)
    model = M.fit(spark.createDataFrame(rows, SERIES).repartition(4), ["energy_price"], ["district", "tariff"], 2.0)
    want, zones, keys = dense(rows, 2.0)
    assert np.allclose(list(model.coefficients.values()), want[:8], atol=1e-5)
    assert np.allclose([r.level for r in model.zones.orderBy("zone_id").collect()], want[8 : 8 + len(zones)], atol=1e-5)
    assert {r.key: pytest.approx(r.level, abs=1e-5) for r in model.levels.collect()} == dict(zip(keys, want[8 + len(zones) :].tolist(), strict=True))


def test_recursion_with_bias_and_schedule(spark):
    rows = made_up()
    table = spark.createDataFrame(rows, SERIES)
    past, ahead = table.where(F.col("timestamp") < DAY + timedelta(hours=60)), table.where(F.col("timestamp") >= DAY + timedelta(hours=60))
    model = M.fit(past, ["energy_price"], ["district", "tariff"], 2.0, validation=ahead.where(F.col("timestamp") < DAY + timedelta(hours=65)))
    schedule = ahead.select("zone_id", "timestamp", F.lit(0.7).alias("energy_price"))
    future = ahead.drop("load_kwh").unionByName(spark.createDataFrame([("new", DAY + timedelta(hours=60), 0.1, "west", "day")], "zone_id string, timestamp timestamp_ntz, energy_price double, district string, tariff string"))
    got = {(r.zone_id, r.timestamp): (r.offset, r.predicted_kwh) for r in M.predict(model, past, future, schedule).collect()}
    c = list(model.coefficients.values())
    zones, levels = {r.zone_id: r.level for r in model.zones.collect()}, {r.key: r.level for r in model.levels.collect()}

    def plainly(rows_, bias, price):
        out = {}
        for z in sorted({r[0] for r in rows_}):
            known = [r[2] for r in rows if r[0] == z and r[1] < DAY + timedelta(hours=60) and r[2] is not None][-24:]
            for k, r in enumerate(x for x in rows_ if x[0] == z):
                x = vector(r[1], price if price is not None else r[3], known[-1] if known else 0.0, known[-24] if len(known) >= 24 else known[-1] if known else 0.0)
                more = zones.get(z, 0.0) + levels.get(f"district={r[4]}", 0.0) + levels.get(f"tariff={r[5] or ''}", 0.0)
                own = bias.get(z, [])
                known.append(max(0.0, float(np.dot(c, x)) + more + (own[k % len(own)] if own else 0.0)))
                out[z, r[1]] = k, known[-1]
        return out

    later = [r for r in rows if r[1] >= DAY + timedelta(hours=60)]
    first = [r for r in later if r[1] < DAY + timedelta(hours=65)]
    raw = plainly(first, {}, None)
    bias = {}
    for r in first:
        if r[2] is not None:
            bias.setdefault(r[0], []).append(r[2] - raw[r[0], r[1]][1])
    assert {r.zone_id: pytest.approx(r.bias, abs=1e-6) for r in model.bias.collect()} == bias
    want = plainly(later, bias, 0.7) | plainly([("new", DAY + timedelta(hours=60), None, 0.1, "west", "day")], {}, 0.0)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)

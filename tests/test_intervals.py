"""Intervals against plain loops: overlapping, touching, open, empty ones; many of one key over several ranges."""

import random
from datetime import datetime, timedelta

import pytest

from zoneload.operators.intervals import covered, merged

SPANS = "zone string, start timestamp_ntz, end timestamp_ntz"
DAY = datetime(2024, 1, 1)


def made_up(seed, n, points):
    r = random.Random(seed)
    at = lambda: DAY + timedelta(hours=r.randrange(200))
    zone = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    spans = []
    for _ in range(n):
        a = at()
        spans.append((zone(), None if r.random() < 0.02 else a, None if r.random() < 0.02 else a + timedelta(hours=r.choice([-3, 0, 1, 2, 5, 40]))))
    return spans, [(zone(), None if r.random() < 0.05 else at(), r.randrange(3)) for _ in range(points)]


@pytest.mark.parametrize("seed,n,points,ranges", [(1, 0, 20, 4), (2, 12, 60, 1), (3, 30, 200, 7), (4, 60, 400, 16)])
def test_points_and_merged_intervals(spark, seed, n, points, ranges):
    spans, rows = made_up(seed, n, points)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table, times = spark.createDataFrame(spans, SPANS), spark.createDataFrame(rows, "zone string, t timestamp_ntz, start int")
        got = [tuple(r) for r in covered(times, table, ["zone"], "t").collect()]
        out = [tuple(r) for r in covered(times, table, ["zone"], "t", inside=False).collect()]
        one = [tuple(r) for r in merged(table.where("zone IS NOT NULL"), ["zone"]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    low, high = datetime.min, datetime.max
    inside = lambda z, t: z is not None and t is not None and any(z == s and (a or low) <= t < (b or high) for s, a, b in spans)
    assert sorted(got, key=repr) == sorted((r for r in rows if inside(*r[:2])), key=repr)
    assert sorted(out, key=repr) == sorted((r for r in rows if not inside(*r[:2])), key=repr)
    want = []
    for z in ("hot", "a", "b"):
        joined = []
        for a, b in sorted(((a or low), (b or high)) for s, a, b in spans if s == z):
            if a >= b:
                continue
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        want += [(z, None if a == low else a, None if b == high else b) for a, b in joined]
    assert sorted(one, key=repr) == sorted(want, key=repr)

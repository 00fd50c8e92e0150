"""Nearest centroids through the index of cells against all distances: ties, copies, hot cells, places far away."""

import numpy as np
import pytest

from zoneload.operators import prepare as P
from zoneload.operators import spatial

ZONES = "zone_id string, longitude double, latitude double, ordinal long"
POINTS = "point_id long, longitude double, latitude double"


def places(kind, r, n):
    if kind == "even":
        return r.random((n, 2))
    if kind == "grid":
        return r.random((n, 2)).round(1)
    if kind == "line":
        return np.stack([np.full(n, 114.0), r.random(n)], 1)
    return np.concatenate([r.normal(0, 1e-3, (n - n // 10, 2)), r.normal(0, 50, (n // 10, 2))])


@pytest.mark.parametrize("kind", ["even", "grid", "line", "dense"])
@pytest.mark.parametrize("scaled", [False, True])
def test_index_equals_all_distances(spark, monkeypatch, kind, scaled):
    r = np.random.default_rng(len(kind))
    zone, point = places(kind, r, 400), np.concatenate([places(kind, r, 500), [[1e4, -80.0], [-1e4, 70.0]]])
    zone[7] = zone[3]
    point[:30] = zone[:30]
    zones = spark.createDataFrame([(f"z{i}", float(x), float(y), (i * 7) % 400) for i, (x, y) in enumerate(zone)], ZONES)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(point)], POINTS)
    want = {p.point_id: (p.zone_id, p.distance2) for p in P.nearest_centroid(points, zones, scaled).collect()}
    monkeypatch.setattr(P, "JOIN_CENTROIDS", 0)
    monkeypatch.setattr(spatial, "CELL", 9)
    monkeypatch.setattr(spatial, "TASK", 40)
    got = {p.point_id: (p.zone_id, p.distance2) for p in P.nearest_centroid(points, zones, scaled).collect()}
    assert got == want and len(got) == len(point)


def test_a_point_meets_few_cells(spark, monkeypatch):
    """Of some 400 cells, an evenly placed point needs its own and a few around it."""
    r = np.random.default_rng(5)
    monkeypatch.setattr(spatial, "CELL", 50)
    zones = spark.createDataFrame([(f"z{i}", float(x), float(y), i, float(x), float(y)) for i, (x, y) in enumerate(r.random((20_000, 2)))], "zone_id string, x double, y double, ordinal long, u double, v double")
    cells, placed = spatial.index(zones, 20_000)
    assert cells.side == 20 and max(x["count"] for x in placed.groupBy("cell").count().collect()) < 60
    u, v = r.random(300), r.random(300)
    home = cells.of(u, v)
    met = [[c] for c in home.tolist()]
    reach = np.full(300, 0.01**2)
    counts = []
    while any(ahead := cells.near(u, v, reach, met)):
        met = [a + b for a, b in zip(met, ahead, strict=True)]
    counts = [len(m) for m in met]
    assert max(counts) <= 9 and np.mean(counts) < 3


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "JOIN_CENTROIDS", 0)
    zones = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", None, 2.0, 2), ("c", float("nan"), 2.0, 3), ("d", 1.0, 1.0, 0)], ZONES)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 5.0, float("nan"))], POINTS)
    assert [(p.point_id, p.zone_id, p.distance2) for p in P.nearest_centroid(points, zones).collect()] == [(1, "d", 2.0)]
    assert P.nearest_centroid(points.limit(0), zones).count() == 0

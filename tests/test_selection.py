"""Representative zones on small tables."""

from zoneload.operators.features import CATEGORY_WEIGHTS, representative_zones

FEATURES = sorted({f for w in CATEGORY_WEIGHTS.values() for f in w} - {"weekend_evenness"} | {"mean_load_kwh", "load_cv", "peak_load_kwh", "weekend_ratio"})


def profiles(spark, n):
    rows = [(f"z{i}", *[float((i * (k + 3)) % 11 + i / 10) for k in range(len(FEATURES))]) for i in range(n)]
    return spark.createDataFrame(rows, "zone_id string, " + ", ".join(f"{f} double" for f in FEATURES))


def test_few_zones_are_taken_by_name(spark):
    got = [tuple(r) for r in representative_zones(profiles(spark, 4), 3).orderBy("position").collect()]
    assert got == [("z0", 0, "zone"), ("z1", 1, "zone"), ("z2", 2, "zone")]


def test_categories_then_ranks_then_the_rest(spark):
    few = representative_zones(profiles(spark, 9), 3).orderBy("position").collect()
    assert len(few) == 3 and {r.reason for r in few} == {"category"}
    every = representative_zones(profiles(spark, 9), 20).orderBy("position").collect()
    assert [r.position for r in every] == list(range(9)) and len({r.zone_id for r in every}) == 9
    assert [r.reason for r in every][:5] == ["category"] * 5 and [r.zone_id for r in every][:3] == [r.zone_id for r in few]
    assert {r.reason for r in every[5:]} == {"rank"}

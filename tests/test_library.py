"""Semantics on small literal frames, and invariants of forecasts."""

import datetime as dt
import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneload import fixtures as X
from zoneload.functions import bands, pricing
from zoneload.functions import scalars as S
from zoneload.functions.metric_text import metric_lines
from zoneload.functions.text import analyzed, response_object
from zoneload.operators import evaluation as E
from zoneload.operators import features as A
from zoneload.operators import prepare as P
from zoneload.plans import forecast as C
from zoneload.sources import readers as R
from zoneload.streaming import metrics as M

SF = "/root/testdata/sf0.001"


def at(text):
    return dt.datetime.fromisoformat(text)


def values(df, column):
    return [r[column] for r in df.collect()]


def hourly(spark, zone, loads, start="2024-01-01"):
    rows = [(zone, at(start) + dt.timedelta(hours=i), v) for i, v in enumerate(loads) if v is not ...]
    return spark.createDataFrame(rows, "zone_id string, timestamp timestamp_ntz, load_kwh double")


def test_24_oclock(spark):
    texts = ["2024-02-28 24:00", "2024/12/31 24:00:00", "2024-01-01 24:01", "2024-01-01 07:30", None, "soon", "2024-1-5T24:00Z", " 2024-01-05 24:00:00.000+0800 ", "2024-01-05 24:00:00.001", "2024-01-05 24:00.0", "2024-13-05 24:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(S.datetime_24h(F.col("t")).alias("x")), "x") == [at("2024-02-29"), at("2025-01-01"), None, at("2024-01-01T07:30"), None, None, at("2024-01-06"), at("2024-01-06"), None, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(S.datetime_24h(F.col("t"), strict=True)).collect()


def test_bands(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0), (35.0, 0.0, 100.0), (80.0, 0.0, 100.0), (130.0, 0.0, 100.0), (5.0, 7.0, 7.0), (None, 0.0, 1.0)], "l double, a double, b double")
    got = df.select(bands.classify(bands.range_position(F.col("l"), F.col("a"), F.col("b"))).alias("x"), bands.target(F.col("l"), F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.x for r in got] == ["Low", "Medium", "High", "Extremely High", "Medium", "Low"]
    assert [r.t for r in got][:4] == [35.5, 35.0, 79.5, 79.5]


def test_prices(spark):
    df = spark.createDataFrame([(1.0, 10.0, None), (2.0, None, 3.0), (0.0, None, 3.0), (1.0, None, -0.1), (1.0, -100.0, None)], "b double, s double, p double")
    got = df.select(*[c.alias(n) for n, c in pricing.finalized(F.col("b"), F.col("s"), F.col("p")).items()]).collect()
    assert [tuple(r) for r in got] == [(10.0, 1.1, True), (50.0, 3.0, True), (0.0, 3.0, True), (-110.0, -0.1, False), (-100.0, 0.0, True)]


def test_elasticity(spark):
    rows = [("Residential area", 0.4, None, 2.0, None, None), ("Office", 50.0, 0.0, 9.0, None, None), ("Office", 0.0, 0.0, 0.0, -0.33, 0.5), (None, None, None, None, None, -9.0), (None, None, None, None, None, None), ("x", 0.0, None, None, 0.001, None)]
    df = spark.createDataFrame(rows, "c string, o double, r double, h double, w double, b double")
    got = values(df.select(pricing.elasticity(*[F.col(c) for c in "corhwb"]).alias("e")), "e")
    assert got == pytest.approx([0.45 * 0.9 * 0.85, 0.24 * 0.875, 0.33, 0.7, 0.28, 0.05])


def test_price_reference_rounds_last(spark):
    changes = spark.createDataFrame([(float(i) + 1e-9,) for i in range(21)], "change_pct double")
    got = A.price_reference(changes).first()
    assert (got.p95_pct, got.observations, got.nonzero_observations) == (19.0, 21, 21)
    asked = spark.createDataFrame([(-5.0,), (25.0,), (None,), (0.25,)], "x double")
    assert sorted((r.x or 0, r.percentile, r.exceeds_p95) for r in A.percentile_of(asked, "x", changes).collect()) == [(-5.0, round(600 / 21, 4), False), (0, None, None), (0.25, round(100 / 21, 4), False), (25.0, 100.0, True)]


def test_running_total(spark):
    r = np.random.default_rng(3)
    rows = [(int(v), int(w)) for v, w in zip(r.integers(0, 40, 200), r.integers(0, 9, 200), strict=True)]
    got = A.running_total(spark.createDataFrame(rows, "v long, w long").repartition(5), "v", "w", "upto").collect()
    assert len(got) == 200 and all(g.upto == sum(w for v, w in rows if v <= g.v) for g in got)


def test_even_origins_need_every_hour_of_every_zone(spark):
    full = [1.0] * 24 * 12
    series = hourly(spark, "a", full).unionByName(hourly(spark, "b", full))
    pick = lambda s, n=2: [(r.pick, r.origin.day) for r in A.even_origins(s, n, 2, 1).orderBy("pick").collect()]
    assert pick(series) == [(1, 6), (2, 9)]  # of the 3rd to the 12th
    gap = series.where("NOT (zone_id = 'b' AND timestamp = timestamp_ntz'2024-01-08 13:00:00')")  # takes the 8th to the 10th
    assert pick(gap) == [(1, 5), (2, 7)] and pick(gap, 8) == []


def test_signatures_do_not_depend_on_order(spark):
    rows = [("a", i, i * 0.5) for i in range(300)] + [("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    one = {r.k: (r.signature, r["rows"]) for r in E.signatures(df, ["k"], ["i", "v"]).collect()}
    assert one == {r.k: (r.signature, r["rows"]) for r in E.signatures(df.orderBy(F.desc("i")).repartition(3), ["k"], ["i", "v"]).collect()}
    changed = df.withColumn("v", F.when(F.col("i") == 7, 0.0).otherwise(F.col("v")))
    assert {r.k: r.signature for r in E.signatures(changed, ["k"], ["i", "v"]).collect()}["a"] != one["a"][0] and one["a"][1] == 300


def test_response_of_nearly_constant_prices(spark):
    """Prices that differ in the seventh digit only: sums of squares would lose what the slope is made of."""
    rows = [("z", at("2024-01-01") + dt.timedelta(hours=i), 1000.0 - 3e4 * (i // 24 % 3) * 1e-4, 1e3 + (i // 24 % 3) * 1e-4) for i in range(24 * 9)]
    series = spark.createDataFrame(rows, "zone_id string, timestamp timestamp_ntz, load_kwh double, energy_price double")
    origins = spark.sql("SELECT timestamp_ntz'2024-01-10' AS origin")
    got = C.price_response(C.at_origins(series, origins, -9, 0)).first()
    assert got.slope == pytest.approx(-0.3 * got.mean_load / got.mean_price, rel=1e-6)  # a slope of -30000, bounded
    flat = C.price_response(C.at_origins(series.withColumn("energy_price", F.lit(2.0)), origins, -9, 0)).first()
    assert flat.slope == pytest.approx(-0.1 * flat.mean_load / 2, rel=1e-6)


def test_pooled_errors_tell_provenance_and_coverage(spark):
    day = dt.datetime
    rows = [
        ("in", 1.0, 2.0, 0.5, 1.5, day(2024, 1, 2), True, None), ("in", 3.0, 3.0, 3.5, 4.0, None, None, None),
        ("early", 1.0, 1.0, None, 1.0, day(2024, 1, 2), None, day(2024, 1, 3)), ("out", 2.0, 1.0, 2.0, 2.0, day(2024, 1, 2), False, day(2024, 1, 2)), ("unknown", 2.0, 1.0, 0.0, 1.0, None, False, day(2024, 1, 2)),
    ]
    df = spark.createDataFrame(rows, "k string, actual_kwh double, predicted_kwh double, q10_kwh double, q90_kwh double, origin timestamp_ntz, training_overlap boolean, training_end timestamp_ntz")
    got = {r.k: r for r in E.pooled_errors(df, ["k"]).collect()}
    assert {k: r.out_of_sample for k, r in got.items()} == {"in": False, "early": False, "out": True, "unknown": None}
    assert (got["in"].interval_coverage_pct, got["early"].interval_coverage_pct, got["out"].interval_coverage_pct) == (50.0, None, 100.0)
    assert (got["in"].training_overlap_count, got["in"].training_known_count, got["in"].training_unknown_count) == (1, 1, 1)
    assert (got["in"].actual_total_kwh, got["in"].predicted_total_kwh, got["in"].bias_pct) == (4.0, 5.0, 25.0)
    levels = E.at_levels(df, {"k": ["k"], "all": []})
    assert E.pooled_errors(levels, ["level", "key"]).where("level = 'all'").first().n_total == 5


def test_three_valued(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", True)], "k string, f boolean")
    got = {r.k: (r.a, r.o) for r in df.groupBy("k").agg(S.all_known(F.col("f")).alias("a"), S.any_known(F.col("f")).alias("o")).collect()}
    assert got == {"a": (None, True), "b": (False, None), "c": (True, True)}


def test_cache_usage(spark):
    df = spark.createDataFrame([(10, 4, None), (10, 40, True), (None, 4, True), (10, 4, False)], "p long, c long, ok boolean")
    got = df.select(*[c.alias(n) for n, c in S.cache_usage(F.col("p"), F.col("c"), F.col("ok")).items()]).collect()
    assert [r.cached_tokens for r in got] == [4, None, None, None] and [r.known_cached_tokens for r in got] == [4, 0, 0, 4]


def test_alias_errors():
    assert P.discover_column(["Time", "x"], ["time"]) == "Time" and P.discover_column(["x"], ["time"], required=False) is None
    for columns in (["x"], ["time", "TIME"]):
        with pytest.raises(ValueError):
            P.discover_column(columns, ["time"])


def test_tariff(spark):
    rows = [(1, "Peak(18:00-22:00)", 1.0, 0.3), (1, "Sharp (19:00-20:00)", 2.0, 0.3), (1, "Off-Peak(22:00-02:00)", 0.4, 0.3), (2, "Peak(08:00-10:00)", 1.0, 0.3), (2, "Off-Peak(09:00-11:00)", 0.4, 0.3), (3, "Peak(08:00-09:00)", 1.0, 0.3), (3, "Peak(08:00-09:00)", 1.1, 0.3)]
    got = {(r.month, r.hour): (r.label, r.energy_price, r.conflict) for r in P.tariff_hours(spark.createDataFrame(rows, "month int, period string, energy_price double, service_price double")).collect()}
    assert sorted(h for m, h in got if m == 1) == [0, 1, 18, 19, 20, 21, 22, 23]
    assert got[1, 19] == ("sharp", 2.0, False) and got[1, 18] == ("peak", 1.0, False)
    assert got[2, 9][2] and not got[2, 8][2] and got[3, 8][2]


def test_validation(spark):
    fine = hourly(spark, "001", [1.0, 2.0]).withColumn("energy_price", F.lit(1.0))
    assert P.validated(fine).count() == 2
    for bad in (fine.unionByName(fine), fine.withColumn("energy_price", F.lit(0.0)), fine.withColumn("load_kwh", F.lit(None).cast("double")), fine.limit(0)):
        with pytest.raises(ValueError, match="invalid series"):
            P.validated(bad)


def test_nearest_centroid_ways_agree(spark, monkeypatch):
    r = np.random.default_rng(1)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.random((300, 2)))], "point_id long, longitude double, latitude double")
    zones = spark.createDataFrame([(f"z{i}", float(x), float(y), i) for i, (x, y) in enumerate(r.random((40, 2)).round(1))], "zone_id string, longitude double, latitude double, ordinal long")
    one = {r.point_id: r.zone_id for r in P.nearest_centroid(points, zones).collect()}
    monkeypatch.setattr(P, "JOIN_CENTROIDS", 0)
    assert one == {r.point_id: r.zone_id for r in P.nearest_centroid(points, zones).collect()}


def test_segments_and_targets(spark):
    rows = hourly(spark, "z", [1.0] * 6 + [...] + [1.0] * 4)
    assert sorted((r.segment, r.hours) for r in A.segment_intervals(rows).collect()) == [(1, 6), (2, 4)]
    assert sorted(r.timestamp.hour for r in A.complete_targets(rows, 2, 2, 1).collect()) == [2, 3, 4, 9]


def test_rolling_needs_full_windows(spark):
    got = A.rolling(hourly(spark, "z", [1.0, 3.0, 5.0]), "load_kwh", [2]).orderBy("timestamp").collect()
    assert [r.mean_2 for r in got] == [None, None, 2.0] and got[2].std_2 == 1.0


def test_policy_of_unknown_slots(spark):
    rows = hourly(spark, "z", [1.0, 2.0, 3.0, None, None, None, 4.0, None, 4.0])
    got = A.load_policy(rows, F.lit("2024-01-02").cast("timestamp_ntz")).first()
    assert (got.windows, got.low_kwh, got.high_kwh) == (2, 6.0, 8.0)


def test_price_changes_skip_gaps(spark):
    rows = hourly(spark, "z", [1.0] * 3 + [2.0] * 3 + [...] * 3 + [8.0] * 3).withColumnRenamed("load_kwh", "energy_price")
    assert values(A.price_changes(rows), "change_pct") == [100.0]


def test_first_entry(spark):
    def entry(*states):
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "k int, round int, medium boolean")
        return E.history_fields(df, ["k"]).orderBy(F.desc("round")).first()

    assert (entry(False, True, False).first_entry_round, entry(True, False).first_entry_round) == (1, 0)
    assert not entry(False, None, True).first_entry_known and entry(False, None, True).ever_medium
    assert entry(False, None, False).ever_medium is None and entry(None, True).ever_newly_medium is None
    assert entry(False, False).first_entry_round is None and entry(False, False).ever_medium is False


def test_pooled_errors(spark):
    rows = [("a", 1.0, 2.0), ("a", 0.0, 1.0), ("a", None, 1.0), ("a", 3.0, float("nan")), (None, 2.0, 2.0)]
    got = {r.k: r for r in E.pooled_errors(spark.createDataFrame(rows, "k string, actual_kwh double, predicted_kwh double"), ["k"]).collect()}
    assert (got["a"].n_total, got["a"].n, got["a"].n_mape, got["a"].mape_pct, got["a"].mae) == (4, 2, 1, 100.0, 1.0)
    assert got[None].mae == 0.0 and got[None].rae is None


def test_unknown_totals(spark):
    calls = spark.createDataFrame([("r", 1, "x", 1, 10, 5, 2, None), ("r", 2, "x", 1, None, 5, 2, None)], "run string, step int, agent string, attempt int, prompt_tokens long, completion_tokens long, cached_tokens long, token_usage_complete boolean")
    got = E.usage_summary(calls, ["run"]).first()
    assert got.prompt_tokens is None and got.known_prompt_tokens == 10 and got.token_usage_complete is False and got.p95_prompt_tokens is None


def test_future_does_not_matter(spark):
    series = X.zone_series(spark, SF).where("zone_id LIKE '%-0'")
    origins = spark.sql("SELECT timestamp_ntz'2024-01-22' AS origin")
    changed = series.withColumn("load_kwh", F.when(F.col("timestamp") >= F.lit("2024-01-22").cast("timestamp_ntz"), 1e6).otherwise(F.col("load_kwh")))
    pick = lambda s: sorted((r.zone_id, r.timestamp, round(r.raw_kwh, 9)) for r in C.ar_forecast(s, origins, 14).collect())
    first = pick(series)
    assert first == pick(changed) == pick(series.repartition(7))
    one = [x for z in sorted({z for z, _, _ in first}) for x in pick(series.where(F.col("zone_id") == z))]
    assert one == first


def test_custom_predictor_is_checked(spark):
    rows = hourly(spark, "z", [1.0] * 48).withColumn("origin", F.lit("2024-01-02").cast("timestamp_ntz"))
    past, ahead = rows.where("timestamp < origin"), rows.where("timestamp >= origin").drop("load_kwh")
    bad = lambda context, future: future[["timestamp"]].assign(predicted_kwh=np.nan)
    with pytest.raises(Exception, match="finite value"):
        C.custom_predictor(past, ahead, bad).collect()


def test_matrix_and_schema_errors(spark, tmp_path):
    (tmp_path / "m.csv").write_text("time,001,2\n2024-01-01 00:00,1,x\n2024-01-01 00:00,2,3\n2024-01-01 24:00,,4\n")
    got = R.read_wide_matrix(spark, str(tmp_path / "m.csv"), "v")
    assert {r.zone_id for r in got.collect()} == {"001", "2"} and got.where("v IS NULL").count() == 2
    bad = R.hourly_matrix_violations(spark, str(tmp_path / "m.csv")).first()
    assert (bad.repeated_times, bad.missing_hours, bad.bad_cells) == (1, 23, 2)
    with pytest.raises(ValueError, match="irregular"):
        R.read_hourly_matrix(spark, str(tmp_path / "m.csv"), "v")
    (tmp_path / "run=a").mkdir()
    (tmp_path / "run=a" / "c.json").write_text('{"schema_version": 9, "zones": []}\n')
    with pytest.raises(Exception, match="unknown schema version"):
        R.read_control_results(spark, str(tmp_path / "run=a")).collect()


def test_metric_series(spark):
    rows = [("c", i, v) for i, v in ((0, 1.0), (1, 4.0), (2, 2.0), (4, 7.0))] + [("d", i, float(i)) for i in range(5)]
    got = {r.name: r for r in M.series_summary(spark.createDataFrame(rows, "name string, scrape_index long, value double"), ["name"], 0, 4).collect()}
    assert M.series_summary(spark.createDataFrame([("e", 0, 5.0), ("e", 2, 1.0)], "name string, scrape_index long, value double"), ["name"], 0, 2).first().resets == 1  # across a missed scrape
    assert (got["c"].known_delta, got["c"].resets, got["c"].delta) == (3.0, 1, None) and got["d"].delta == 4.0


def test_metric_text_and_json(spark):
    text = '# TYPE lat histogram\nlat_bucket{le="+Inf",p="a\\"b\\\\n"} 3 # {id="x"} 1\nlat_sum 2.5 1700000000\nlat_created 7\nup NaN\n# HELP x\n# TYPE req counter\nreq_total 4\nother_total 1\n'
    got = {r.name: r for r in metric_lines(spark.createDataFrame([(1, text)], "k int, text string")).collect()}
    assert got["lat_bucket"].labels == {"le": "+Inf", "p": 'a"b\\n'} and got["lat_sum"].type == "histogram" and got["up"].value is None and got["up"].value_text == "NaN"
    assert (got["lat_created"].type, got["lat_created"].component, got["lat_created"].family) == ("gauge", "created", "lat")
    assert (got["req_total"].type, got["req_total"].component) == ("counter", "total") and (got["other_total"].type, got["other_total"].component) == ("untyped", "")
    for bad in ('a{x="1"} 1\na{x="1"} 2', 'a{x="1",x="2"} 1', 'a{x=1} 1', 'a{1x="y"} 1', 'a{x="\\q"} 1', 'a{x="1" 1', "a", "a 1 2 3", "9a 1", "a one"):
        with pytest.raises(Exception, match="invalid metric line|repeated"):
            metric_lines(spark.createDataFrame([(1, bad)], "k int, text string")).collect()
    loose = metric_lines(spark.createDataFrame([(1, "a 1 2 3"), (2, "a 1")], "k int, text string"), strict=False)
    assert values(loose, "k") == [2] and metric_lines(spark.createDataFrame([(1, "b 1\nx 2")], "k int, text string"), prefix="x").first().name == "x"
    keys = '{"Thoughts": 1, " analysis ": 2, "chain-of-thought": 3, "CHAIN_OF_THOUGHT": 4, "reasoning": 5, "thinking": 6, "l": [{"reasoning": 1, "b": 2}]}'
    assert values(spark.createDataFrame([(keys,)], "t string").select(response_object("t").alias("o")), "o") == ['{"l": [{"b": 2}], "thinking": 6}']
    df = spark.createDataFrame([('x {"a": {"thoughts": 1, "b": 2}} y',), ("none {",), (None,)], "t string")
    assert values(df.select(response_object("t").alias("o")), "o") == ['{"a": {"b": 2}}', None, None]


def test_analyzer(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert analyzed(df).first().analysis == '{"status": "not_configured"}'
    assert analyzed(df, lambda r: {"n": r["a"], "b": r["b"]}).first().analysis == '{"b": null, "n": 1}'
    with pytest.raises(Exception, match="returns a dict"):
        analyzed(df, lambda r: 3).collect()


def test_supervised_windows(spark):
    series = hourly(spark, "z", [float(i) for i in range(60)]).withColumn("energy_price", F.lit(1.0))
    got = C.supervised_windows(series, 24, 3, ["energy_price"]).orderBy("timestamp").collect()
    assert [r.timestamp.hour for r in got] == [0, 0] and got[0].history[-1] == 23.0 and got[0].targets == [24.0, 25.0, 26.0]


def test_supervised_windows_of_every_hour_within_segments(spark):
    loads = [float(i * i % 17) for i in range(60)]
    series = hourly(spark, "z", loads).withColumn("energy_price", F.when(F.hour("timestamp") != 5, 1.0))
    want = 60 - 24 - 3 + 1
    end = series.orderBy("timestamp").collect()[40].timestamp
    got = C.supervised_windows(series, 24, 3, ["energy_price"], stride=1, train_end=F.lit(end)).orderBy("timestamp").collect()
    assert len(got) == want
    mean, std = np.mean(loads[:40]), np.std(loads[:40])
    scaled = (np.array(loads) - mean) / std
    for at, r in enumerate(got, 24):
        assert np.allclose(r.history, scaled[at - 24 : at], atol=1e-5) and np.allclose(r.targets, scaled[at : at + 3], atol=1e-5)
        assert np.allclose([r.load_mean, r.load_std, r.load_mean_24, r.load_std_24], [mean, std, scaled[at - 24 : at].mean(), scaled[at - 24 : at].std()])
        hours = (r.timestamp.hour + np.arange(3)) % 24
        assert r.future_energy_price_missing == [float(h == 5) for h in hours] and [np.isnan(x) for x in r.future_energy_price] == [h == 5 for h in hours]
        assert np.allclose(r.future_hour_sin, np.sin(hours * 2 * np.pi / 24), atol=1e-6) and len(r.future_weekday_cos) == 3
    gap = series.where(F.col("timestamp") != F.lit(end))  # 40 hours, then 19
    assert C.supervised_windows(gap, 24, 3, [], stride=1).count() == 40 - 24 - 3 + 1


def test_round_grid_carries_early_stops(spark):
    rows = spark.createDataFrame([(w, r, 1.0 + r, x) for w in "abc" for r, x in enumerate(["Low", "High"])], "window string, round long, load_kwh double, stress string")
    finals = spark.createDataFrame([("a", "success", 1, 3, 9.0, "Medium"), ("b", "fail", 1, 3, 9.0, "Medium"), ("c", "success", 1, 1, 9.0, "Medium")], "window string, status string, attempts_used long, attempt_limit long, load_kwh double, stress string")
    grid = E.round_grid(rows, ["window"], 3, finals)
    got = {(r.window, r.round): (r.load_kwh, r.medium, r.source) for r in grid.collect()}
    assert len(got) == 12 and got["a", 1] == (2.0, False, "attempt_trace")
    assert got["a", 2] == got["a", 3] == (9.0, True, "early_stop_carry")
    assert all(got[w, r] == (None, None, "missing") for w in "bc" for r in (2, 3))
    last = {r.window: r for r in E.final_rows(grid, ["window"], finals).collect()}
    assert sorted(last) == ["a", "b", "c"]
    assert all((r["round"], r.load_kwh, r.medium, r.previous_medium, r.first_entry_round, r.source) == (1, 9.0, True, False, 1, "final_windows") for r in last.values())


def test_entry_module_without_corpus_package(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("zoneload.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name, name=name)

    for name in [n for n in sys.modules if n.startswith(("zoneload.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "job_ar_forecast" in entry.queries() and "op1_suffix_dedup" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


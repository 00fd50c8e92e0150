"""Saved results of several versions: names at any depth, conflicts, malformed files, rounds of nested windows."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneload.sources.results import accepting, normalised, read_results, rounds_of


def written(folder, run, *texts):
    (folder / f"run={run}").mkdir(parents=True)
    (folder / f"run={run}" / "control_results.json").write_text("\n".join(texts))


def result(version, names, **more):
    origin, model = names
    zone = {"zone_id": "001", origin: "z-day", model: "z-model", "final_windows": [{"window_start": "00:00", "window_end": "02:00"}]}
    return json.dumps({"schema_version": version, "status": "fail", origin: "day", model: "ar", "parameters": {model: "p", "alpha": "1"}, "zones": [zone], **more})


OLD, NEW = ("forecast_start", "forecast_model"), ("forecast_origin", "backend")


def test_versions_give_the_same_rows(spark, tmp_path):
    written(tmp_path, "a", result(2, OLD))
    written(tmp_path, "b", result(3, NEW, forecast_start="day"))
    written(tmp_path, "c", result(4, NEW))
    got, bad = read_results(spark, str(tmp_path))
    rows = {r.run: r for r in got.collect()}
    assert {r.schema_version for r in rows.values()} == {2, 3, 4}
    flat = {(r.forecast_origin, r.backend, r.zones[0].forecast_origin, r.zones[0].backend, r.zones[0].zone_id, tuple(sorted(r.parameters.items()))) for r in rows.values()}
    assert flat == {("day", "ar", "z-day", "z-model", "001", (("alpha", "1"), ("backend", "p")))}
    assert bad.count() == 0 and rows["a"].zones[0].attempt_trace is None


@pytest.mark.parametrize("text", [result(4, NEW, forecast_start="other"), result(4, NEW).replace('"z-day"', '"z-day", "forecast_start": "x"'), result(4, NEW).replace('"alpha"', '"forecast_model": "q", "alpha"'), result(5, NEW), result(4, NEW).replace("4", "null", 1)])
def test_conflicts_and_unknown_versions_fail(spark, tmp_path, text):
    written(tmp_path, "a", text)
    with pytest.raises(PySparkException, match="conflicting fields|unknown schema version"):
        read_results(spark, str(tmp_path))[0].collect()


def test_malformed_files_are_kept_apart(spark, tmp_path):
    written(tmp_path, "a", result(4, NEW), "{broken", result(3, NEW))
    written(tmp_path, "b", "")
    written(tmp_path, "c", '{"schema_version": "four"}')
    got, bad = read_results(spark, str(tmp_path))
    assert sorted(r.schema_version for r in got.collect()) == [3, 4]
    assert sorted((r.path.split("run=")[1][0], r.text) for r in bad.collect()) == [("a", "{broken"), ("c", '{"schema_version": "four"}')]
    whole, bad = read_results(spark, str(tmp_path / "run=c"), lines=False)
    assert whole.count() == 0 and bad.count() == 1


def test_nested_renaming_keeps_nulls_and_types(spark):
    kind = T.StructType.fromDDL("a array<struct<x: int, inner: struct<new: double>>>, m map<string, long>")
    wide = accepting(kind, {"old": "new"})
    assert "old" in wide.simpleString()
    text = [('{"a": [null, {"x": 1, "inner": {"old": 2.5}}, {"inner": null}], "m": {"old": 3, "k": null}}',), ('{"a": null, "m": {"new": 4}}',), (None,)]
    rows = spark.createDataFrame(text, "t string").select(normalised(F.from_json("t", wide), kind, {"old": "new"}).alias("r"))
    got = [r.r.asDict(True) if r.r else None for r in rows.collect()]
    assert got[0] == {"a": [None, {"x": 1, "inner": {"new": 2.5}}, {"x": None, "inner": None}], "m": {"k": None, "new": 3}}
    assert got[1] == {"a": None, "m": {"new": 4}} and got[2] is None
    assert rows.schema["r"].dataType.simpleString() == kind.simpleString()


def test_rounds_of_nested_windows(spark, tmp_path):
    window = lambda n, **more: {"window_start": f"{n}:00", "window_end": f"{n + 2}:00", **more}
    attempts = [{"attempt": 2, "windows": [window(0, reforecast_load_stress_level="Medium", proposed_energy_price=2.0, price_valid=False, control_success=True)]}, {"attempt": 1, "windows": [window(0, load_stress_level="High", reforecast_load_stress_level="High"), window(3, load_stress_level="Low")]}]
    zones = [{"zone_id": "a", "attempt_trace": attempts, "final_windows": [window(0, reforecast_load_stress_level="Medium", sum_predicted_kwh=5.0)]}, {"zone_id": "b", "attempts_used": 1, "final_windows": [window(0, load_stress_level="Low")]}]
    written(tmp_path, "r", json.dumps({"schema_version": 3, "status": "success", "attempt_limit": 3, "zones": zones}))
    rounds, finals = rounds_of(read_results(spark, str(tmp_path))[0])
    got = {(r.zone_id, r.window_start, r.round): (r.load_kwh, r.stress, r.price, r.control_success) for r in rounds.collect()}
    assert got == {
        ("a", "0:00", 0): (5.0, "High", None, None), ("a", "3:00", 0): (None, "Low", None, None), ("b", "0:00", 0): (None, "Low", None, None),
        ("a", "0:00", 1): (None, "High", None, None), ("a", "3:00", 1): (None, None, None, None), ("a", "0:00", 2): (None, "Medium", None, True),
    }
    assert {(r.zone_id, r.status, r.attempts_used, r.attempt_limit, r.stress) for r in finals.collect()} == {("a", "success", 2, 3, "Medium"), ("b", "success", 1, 3, None)}
    for broken in ([*zones, zones[1]], [{**zones[0], "attempt_trace": attempts + attempts[:1]}]):
        folder = tmp_path / f"broken{len(broken)}"
        written(folder, "x", json.dumps({"schema_version": 3, "zones": broken}))
        with pytest.raises(PySparkException, match="is repeated"):
            [x.collect() for x in rounds_of(read_results(spark, str(folder))[0])]

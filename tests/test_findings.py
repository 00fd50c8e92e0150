"""Small cases of faults found on odd or larger input."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.test_oracle import rows
from zoneload.queries import ORACLES, QUERIES
from zoneload.sources import readers as R


def events(folder, users):
    """A table of events of so many users, one each, over two hours."""
    at = [1_704_067_200_000_000 + (u % 2) * 3_600_000_000 for u in range(users)]
    columns = {"event_id": pa.array(range(users), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array(range(users), pa.int64()), "event_type": ["click"] * users, "value": [float(u % 7) for u in range(users)]}
    pq.write_table(pa.table(columns), folder / "events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name, table):
    with duckdb.connect() as connection:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = connection.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)


def test_wide_files_beyond_the_columns_of_a_plan(spark, tmp_path):
    n = 21_000
    (tmp_path / "m.csv").write_text(",".join(["time", *[f"z{i}" for i in range(n)]]) + "\n" + "\n".join(",".join([f"2024-01-01 0{h}:00:00", *["x" if i == 7 else str(i) for i in range(n)]]) for h in (0, 1)) + "\n")
    assert R.hourly_matrix_violations(spark, str(tmp_path / "m.csv")).first() == (0, 0, 0, 0, 2)
    got = R.read_wide_matrix(spark, str(tmp_path / "m.csv"), "v")
    assert got.count() == 2 * n and {r.v for r in got.where("zone_id = 'z20999'").collect()} == {20999.0} and got.where("v IS NULL").count() == 2


def test_cells_of_wide_files(spark, tmp_path):
    """Quotes, short and long lines, columns without a name or with the same."""
    (tmp_path / "m.csv").write_text(',"a,b",c,C\n"2024-01-01 00:00","1",2,3\n2024-01-01 01:00,"4"\n2024-01-01 02:00,,"x""y",6,7\n')
    got = {(r.timestamp.hour, r.zone_id): r.v for r in R.read_wide_matrix(spark, str(tmp_path / "m.csv"), "v").collect()}
    assert got == {(0, "a,b"): 1, (0, "c2"): 2, (0, "C3"): 3, (1, "a,b"): 4, (1, "c2"): None, (1, "C3"): None, (2, "a,b"): None, (2, "c2"): None, (2, "C3"): 6}
    assert R.hourly_matrix_violations(spark, str(tmp_path / "m.csv")).first().bad_cells == 4


@pytest.mark.parametrize("name", ["src_wide_matrix", "src_station_tou"])
def test_zones_of_every_last_digit(spark, tmp_path, name):
    same_as_sql(spark, events(tmp_path, 440), name, "events")


def test_runs_that_share_a_file(spark, tmp_path):
    """A line's own run goes before the path's; results of many runs make no folder each."""
    (tmp_path / "run=p").mkdir()
    (tmp_path / "run=p" / "a.json").write_text('{"schema_version": 4, "run": "x", "zones": []}\n{"schema_version": 4, "zones": []}\n')
    assert sorted(r.run for r in R.read_control_results(spark, str(tmp_path)).collect()) == ["p", "x"]
    lines = {"l_orderkey": pa.array([64 * i for i in range(600)], pa.int64()), "l_partkey": pa.array([1] * 600, pa.int64()), "l_suppkey": pa.array([1] * 600, pa.int64()), "l_linenumber": pa.array([1] * 600, pa.int32()), "l_quantity": [20.0] * 600}
    pq.write_table(pa.table(lines), tmp_path / "lineitem.parquet")
    same_as_sql(spark, str(tmp_path), "src_control_results", "lineitem")
    got = QUERIES["src_control_results"](spark, str(tmp_path))
    assert len(got.inputFiles()) < 100


def test_zones_are_dealt_before_they_meet_the_hours(spark, tmp_path):
    """Before, the few bytes of all zones came to one task, which laid out their hours and held them all."""
    from zoneload.fixtures import zone_series

    folder = events(tmp_path, 30_000)
    rows = zone_series(spark, folder).select("zone_id", "timestamp", "energy_price")
    assert rows.rdd.getNumPartitions() >= 3
    assert rows.count() == 750 * 720
    same_as_sql(spark, folder, "flt_validate_series", "events")


@pytest.mark.parametrize("most", [100_000, 1])
def test_errors_of_large_groups(spark, monkeypatch, most):
    """Before, all rows of a group went to one task for its mean, unless Spark chose to broadcast."""
    from zoneload.operators import evaluation as E

    monkeypatch.setattr(E, "BROADCAST_GROUPS", most)
    rows = spark.createDataFrame([("a" if i % 10 else None, float(i % 7), float(i % 5)) for i in range(1000)], "k string, actual_kwh double, predicted_kwh double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = E.pooled_errors(rows, ["k"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) if most > 1 else ("__part" in plan)
        got = {r.k: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k in ("a", None):
        mine = [(i % 7, i % 5) for i in range(1000) if (k is None) == (i % 10 == 0)]
        mean = sum(a for a, _ in mine) / len(mine)
        assert got[k].n == len(mine) and abs(got[k].rae - sum(abs(a - p) for a, p in mine) / sum(abs(a - mean) for a, _ in mine)) < 1e-9


def test_saved_results_are_parsed_once(spark, tmp_path):
    """Before, rounds and finals parsed the texts four times, and each time once more to tell malformed ones."""
    from zoneload.sources.results import read_results, rounds_of

    window = '{"window_start": "w0", "window_end": "e0", "reforecast_load_kwh": 2, "sum_predicted_kwh": 1}'
    (tmp_path / "a.json").write_text(f'{{"schema_version": 4, "run": "x", "zones": [{{"zone_id": "a", "attempt_trace": [{{"attempt": 1, "windows": [{window}]}}], "final_windows": [{window}]}}]}}\n{{broken\n')
    results, broken = read_results(spark, str(tmp_path))
    texts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    assert texts(results) == 1 and broken.count() == 1
    rounds, finals = rounds_of(results)
    assert texts(rounds) == texts(finals) == 0
    assert sorted((r.round, r.load_kwh) for r in rounds.collect()) == [(0, 1.0), (1, 2.0)] and [r.load_kwh for r in finals.collect()] == [2.0]


@pytest.mark.parametrize("levels", [12, 1])
def test_decisions_are_opened_where_they_are(spark, monkeypatch, levels):
    """Before, each level doubled the tasks, and lines were shuffled to be grouped by their row again."""
    from zoneload.functions import canonical as CF

    monkeypatch.setattr(CF, "LEVELS", levels)
    texts = ['{"a": [1, {"b": [[], {"c/d": "]]{\\\\\\""}]}], "agreements": [{"x": 1}]}', "[[[[" + "]" * 4, "[[[{", None, "2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = CF.leaves(rows, ["k"], "t")
    assert got.rdd.getNumPartitions() <= 3
    found = {}
    for r in got.collect():
        found.setdefault(r.k, {})[r.path] = r.value
    assert found == {
        0: {"": "{", "/a": "[", "/a/0": "n:1.000000", "/a/1": "{", "/a/1/b": "[", "/a/1/b/0": "[", "/a/1/b/1": "{", "/a/1/b/1/c~1d": 's:]]{\\"'},
        1: {"": "[", "/0": "[", "/0/0": "[", "/0/0/0": "["}, 2: {"": "?[[[{"}, 4: {"": "n:2.000000"},
    }


def test_series_is_made_once_for_forecasts_and_control(spark):
    """Before, each of the forecast's parts made the series of all zones and hours anew from the events."""
    from zoneload.catalog.control import _inputs

    made = [QUERIES["job_daily_backtest"](spark, "/root/testdata/sf0.001"), *_inputs(spark, "/root/testdata/sf0.001")]
    assert not any("events.parquet" in f for df in made for f in df.inputFiles())


def test_lags_are_those_of_the_horizon(spark):
    """Before, all hours of the history, for each origin, were sent to meet the few ahead."""
    from zoneload.plans import forecast as C

    series = spark.sql("SELECT 'z' AS zone_id, t AS timestamp, 1d * hour(t) AS load_kwh, 1d AS energy_price FROM (SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-20', interval 1 hour)) AS t)")
    rows = C.ar_forecast(series, spark.sql("SELECT timestamp_ntz'2024-01-16' AS origin"), 14, 2)
    got = {(r.timestamp.day, r.timestamp.hour): r.base_kwh for r in rows.collect()}
    assert len(got) == 48 and all(abs(v - h) < 1e-9 for (_, h), v in got.items())


def test_proposals_are_joined_where_they_are(spark):
    """Before, tasks grew with the tables, as all rows were dealt to as many parts as the session's setting has."""
    from zoneload.catalog import control as V

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = V.K.normalized_windows(*V._keyed(spark, "/root/testdata/sf0.001"), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2


def test_no_plan_holds_all_zones_of_a_wide_file(spark, tmp_path):
    """The header is a line of the file, not a name: what the driver keeps of a plan doesn't grow with the zones."""
    sizes = []
    for users in (4_000, 40_000):
        folder = tmp_path / str(users)
        folder.mkdir()
        got = QUERIES["src_city_wide"](spark, events(folder, users))
        assert got.select("zone_id").distinct().count() == users // 40
        sizes.append(len(got._jdf.queryExecution().toString()))
    assert sizes[1] < 1.1 * sizes[0]


def test_parts_of_wide_files_have_their_header(spark, tmp_path, monkeypatch):
    from zoneload.catalog import sources

    monkeypatch.setattr(sources, "PART_CELLS", 1_000)
    same_as_sql(spark, events(tmp_path, 440), "src_wide_matrix", "events")
    same_as_sql(spark, str(tmp_path), "src_city_wide", "events")

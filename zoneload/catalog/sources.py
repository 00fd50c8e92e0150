"""Queries over readers and writers: each writes what it reads to the shared folder first."""

import math

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import evaluation as E
from ..operators import features as A
from ..registry import query
from ..session import checkpoint, shared_folder
from ..sources import readers as R
from ..sources import sinks as W
from .evaluate import _ERRORS, _WK, _errors_sql
from .forecast import _WINDOWS, windows

_C = F.col


#: Cells of a wide file's part, about.
PART_CELLS = 2_000_000


def wide(rows, value, path, broken=False):
    """Write a wide CSV of one column per zone, in parts that begin with the header line. Lines are texts, the header too: no
    plan has a column per zone, nor a name that holds them all, and no zone goes through the driver."""
    rows = checkpoint(rows.select("timestamp", "zone_id", _C(value).cast("string").alias("cell")))
    zones = rows.select("zone_id").distinct()
    if broken:
        first = zones.agg(F.min("zone_id")).first()[0]
        rows = rows.withColumn("cell", F.when((_C("zone_id") == first) & (F.hour("timestamp") == 5), "n/a").otherwise(_C("cell")))
    # Every time and zone, in place of a pivot's empty cells; times are as many as hours.
    every = zones.crossJoin(F.broadcast(rows.select("timestamp").distinct())).join(rows, ["timestamp", "zone_id"], "left")
    line = F.sort_array(F.collect_list(F.struct("zone_id", F.coalesce("cell", F.lit("")).alias("cell"))))["cell"]
    count = max(1, math.ceil(rows.count() / PART_CELLS))
    parts = F.lit(count)
    texts = every.groupBy("timestamp").agg(line.alias("cells")).select(
        F.pmod(F.xxhash64("timestamp"), parts).cast("int").alias("part"), F.lit(1).alias("place"), F.concat_ws(",", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "cells").alias("value")
    )
    names = F.concat_ws(",", F.lit("time"), F.sort_array(F.collect_list("zone_id")))
    header = zones.agg(names.alias("value")).select(F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("place"), "value")
    both = header.unionByName(texts)
    both.repartition(count, "part").sortWithinPartitions("part", "place").select("value").write.text(path)
    return path


@query("src_wide_matrix", "SELECT timestamp, z.zone_id, CASE WHEN hour = 5 AND z.zone_id = (SELECT min(zone_id) FROM zone_hourly) THEN NULL ELSE o.load_kwh END AS load_kwh FROM (SELECT DISTINCT zone_id FROM zone_hourly) z CROSS JOIN (SELECT DISTINCT timestamp, extract(hour FROM timestamp) AS hour FROM zone_hourly) t LEFT JOIN zone_hourly o USING (zone_id, timestamp)", X.HOURLY)
def wide_matrix(spark, d):
    path = wide(X.zone_hourly(spark, d), "load_kwh", f"{shared_folder(spark)}/load.csv", broken=True)
    return R.read_wide_matrix(spark, path, "load_kwh")


@query("src_hourly_matrix", "SELECT 0 AS unknown_times, 0 AS repeated_times, 0 AS odd_times, 720 - count(DISTINCT timestamp) AS missing_hours, count(DISTINCT timestamp) * count(DISTINCT zone_id) - count(*) AS bad_cells FROM zone_hourly WHERE extract(day FROM timestamp) <> 9", X.HOURLY)
def hourly_matrix(spark, d):
    path = wide(X.zone_hourly(spark, d).where(F.dayofmonth("timestamp") != 9), "load_kwh", f"{shared_folder(spark)}/load.csv")
    return R.hourly_matrix_violations(spark, path)


@query("src_city_wide", "SELECT timestamp, zone_id, load_kwh, energy_price, service_price, occupancy, temperature, humidity, rain, hour, day_of_week, is_weekend, temperature * energy_price AS temperature_price_interaction FROM zone_series", X.SERIES, "occupancy temperature_price_interaction")
def city_wide(spark, d):
    series, folder = X.zone_series(spark, d), shared_folder(spark)
    paths = [wide(series, c, f"{folder}/{c}.csv") for c in ("load_kwh", "energy_price", "service_price", "occupancy")]
    return R.city_series(spark, *paths, X.weather(spark))


@query("src_site_wide", "SELECT zone_id, CAST(NULL AS VARCHAR) AS reason, count(*) AS hours, sum(CAST(load_kwh AS DECIMAL(18, 2))) :: DOUBLE AS load_kwh FROM zone_series WHERE zone_id NOT LIKE '%-3' GROUP BY zone_id UNION ALL SELECT DISTINCT zone_id, CASE WHEN zone_id LIKE 'click%' THEN 'invalid_price' ELSE 'invalid_energy' END, NULL, NULL FROM zone_series WHERE zone_id LIKE '%-3'", X.SERIES)
def site_wide(spark, d):
    s, folder = X.zone_series(spark, d), shared_folder(spark)
    last = _C("zone_id").like("%-3") & (_C("hour") == 7)
    s = s.withColumns({"load_kwh": F.when(last, -1.0).otherwise(_C("load_kwh")), "energy_price": F.when(last & _C("zone_id").like("click%"), 0.0).otherwise(_C("energy_price"))})
    series, excluded = R.site_series(spark, wide(s, "load_kwh", f"{folder}/load.csv"), wide(s, "energy_price", f"{folder}/price.csv"))
    kept = series.groupBy("zone_id").agg(F.count("*").alias("hours"), F.sum(_C("load_kwh").cast("decimal(18,2)")).cast("double").alias("load_kwh"))
    return kept.unionByName(excluded, allowMissingColumns=True).select("zone_id", "reason", "hours", "load_kwh")


_TOU = "CASE WHEN hour >= 22 OR hour < 6 THEN 0.4e0 WHEN hour IN (6, 7, 12, 13, 14, 15, 16) THEN 0.7e0 WHEN hour IN (19, 20) THEN 1.5e0 ELSE 1.1e0 END"


@query("src_station_tou", f"SELECT zone_id, NULL AS reason, timestamp, load_kwh, {_TOU} AS energy_price FROM zone_series WHERE right(zone_id, 1) = '0' UNION ALL SELECT DISTINCT zone_id, CASE right(zone_id, 1) WHEN '1' THEN 'transaction_counts' WHEN '2' THEN 'missing_tariff' ELSE 'incomplete_tariff' END, NULL, NULL, NULL FROM zone_series WHERE right(zone_id, 1) <> '0'", X.SERIES)
def station_tou(spark, d):
    s = X.zone_series(spark, d)
    power = s.select("zone_id", "timestamp", _C("load_kwh").alias("power_kw"), F.when(_C("zone_id").endswith("1"), 1).alias("session_count"))
    periods = [("Off-Peak(22:00-06:00)", 0.4), ("Shoulder(06:00-08:00, 12:00-17:00)", 0.7), ("Peak(08:00-12:00, 17:00-22:00)", 1.1), ("Sharp(19:00-21:00)", 1.5)]
    table = F.array(*[F.struct(F.lit(t).alias("period"), F.lit(p).alias("energy_price")) for t, p in periods])
    tariffs = s.select("zone_id").distinct().where("NOT zone_id LIKE '%2'").withColumn("k", F.explode(table)).select("zone_id", F.lit(1).alias("month"), "k.period", "k.energy_price", F.lit(0.3).alias("service_price"))
    tariffs = tariffs.where("right(zone_id, 1) IN ('0', '1') OR period NOT LIKE 'Shoulder%'")
    series, excluded = R.station_series(power, tariffs, 2024)
    return series.select("zone_id", "timestamp", "load_kwh", "energy_price").unionByName(excluded, allowMissingColumns=True)


@query("src_forecast_details", _errors_sql("(SELECT CAST(run % 8 AS VARCHAR) AS run, actual_kwh, predicted_kwh FROM base_samples)", ["run"], extra=False), X.SAMPLES, _ERRORS.replace(" interval_coverage_pct", ""))
def forecast_details(spark, d):
    """Saved forecasts of two generations, read back under one set of names."""
    folder = shared_folder(spark)
    rows = X.forecast_samples(spark, d).where("agent_mode = 'multi'").select((_C("run") % 8).alias("run"), _C("zone").cast("string").alias("zone_id"), "time", "actual_kwh", _C("predicted_kwh").alias("p"))
    new = F.when(_C("run") % 2 == 0, _C("p"))
    rows.select("run", "zone_id", "time", "actual_kwh", new.alias("predicted_kwh"), F.when(_C("run") % 2 == 1, _C("p")).alias("forecast_kwh")).write.partitionBy("run").option("header", True).csv(folder)
    got = R.read_forecast_details(spark, folder, "zone_id string, time timestamp_ntz, actual_kwh double, predicted_kwh double, forecast_kwh double", {"forecast_kwh": "predicted_kwh"})
    return E.pooled_errors(got, ["run"])


def results(spark, d):
    """Window rounds as nested control results, written as JSON lines of a run each and read back. Files are as many as tasks,
    not as runs."""
    folder = shared_folder(spark)
    rows = X.window_rounds(spark, d).where("round > 0").select(_C("run").cast("string").alias("run"), _C("zone").cast("string").alias("zone_id"), "window", "round", "load_kwh", "stress")
    start = F.concat(F.lit("w"), _C("window").cast("string"))
    ok = _C("stress") == "Medium"
    told = [start.alias("window_start"), _C("stress").alias("load_stress_level"), _C("load_kwh").alias("reforecast_load_kwh")]
    attempt, last = F.struct(*told, ok.alias("control_success")), F.struct(*told, F.lit(0.5).alias("mean_energy_price"), (_C("window") / 10).alias("proposed_energy_price"), ok.alias("control_success"))
    # Dealt by run once, all groupings below stay where they are; the last round's windows are the final ones.
    per = rows.repartition("run").groupBy("run", "zone_id", "round").agg(F.sort_array(F.collect_list(attempt)).alias("windows"), F.sort_array(F.collect_list(F.when(_C("round") == 3, last))).alias("last"))
    calls = F.array(F.struct(F.lit("economist").alias("agent"), F.size("windows").cast("long").alias("prompt_tokens"), _C("round").alias("completion_tokens")))
    trace = F.sort_array(F.collect_list(F.struct(_C("round").alias("attempt"), "windows", calls.alias("calls"))))
    zone = per.groupBy("run", "zone_id").agg(trace.alias("attempt_trace"), F.max(F.when(_C("round") == 3, _C("last"))).alias("final_windows"))
    good = F.when(F.forall("final_windows", lambda w: F.coalesce(w["control_success"], F.lit(False))), "success").otherwise("fail")
    nested = zone.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("zone_id", good.alias("status"), F.lit(3).cast("long").alias("attempts_used"), "attempt_trace", "final_windows"))).alias("zones"))
    version, start, model = _C("run").cast("long") % 3 + 2, F.concat(F.lit("2024-01-0"), (_C("run").cast("long") % 9 + 1).cast("string")), F.concat(F.lit("model-"), (_C("run").cast("long") % 4).cast("string"))
    # Version 2 has the older names, version 3 both, version 4 the newer ones.
    named = [F.when(version < 4, start).alias("forecast_start"), F.when(version > 2, start).alias("forecast_origin"), F.when(version < 4, model).alias("forecast_model"), F.when(version > 2, model).alias("backend")]
    nested.select("run", version.alias("schema_version"), *named, F.lit("fail").alias("status"), F.lit(3).alias("attempt_limit"), F.lit(3).alias("attempts_used"), "zones").write.json(folder)
    return R.read_control_results(spark, folder)


@query("src_control_results", "SELECT run % 3 + 2 AS schema_version, '2024-01-0' || (run % 9 + 1) AS forecast_origin, 'model-' || run % 4 AS backend, CAST(run AS VARCHAR) AS run, CAST(zone AS VARCHAR) AS zone_id, round AS attempt, 'w' || \"window\" AS window_start, stress AS load_stress_level, load_kwh AS reforecast_load_kwh, stress = 'Medium' AS control_success FROM window_rounds WHERE round > 0", X.ROUNDS)
def control_results(spark, d):
    """Results of three schema versions under one set of names."""
    flat = R.flat_windows(results(spark, d), ["run", "schema_version", "forecast_origin", "backend"], "attempts")
    return flat.select("schema_version", "forecast_origin", "backend", "run", "zone_id", "attempt", "window_start", "load_stress_level", "reforecast_load_kwh", "control_success")


@query("sink_control_tables", """SELECT 'final_windows' AS name, count(*) AS rows, CAST(NULL AS BIGINT) AS tokens FROM window_rounds WHERE round = 3 UNION ALL SELECT 'attempt_trace', count(*), NULL FROM window_rounds WHERE round > 0 UNION ALL SELECT 'attempt_usage', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM window_rounds WHERE round > 0 GROUP BY run, zone, round)
    UNION ALL SELECT 'step_usage', count(DISTINCT run), CAST(count(*) AS BIGINT) FROM window_rounds WHERE round > 0 UNION ALL SELECT 'run_summary', count(DISTINCT run), NULL FROM window_rounds""", X.ROUNDS)
def control_tables(spark, d):
    folder = shared_folder(spark)
    out = None
    for name in W.write_tables(W.control_tables(checkpoint(results(spark, d))), folder):
        table = spark.read.parquet(f"{folder}/{name}")
        tokens = F.sum("prompt_tokens") if "prompt_tokens" in table.columns else F.lit(None).cast("long")
        part = table.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), tokens.alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_canonical", "SELECT zone_id, count(*) AS rows, max(energy_price) AS highest FROM zone_series WHERE zone_id NOT LIKE '%-3' GROUP BY zone_id", X.SERIES)
def canonical(spark, d):
    """Written twice under one name and once under another: the second writing replaces the first only."""
    folder, series = shared_folder(spark), X.zone_series(spark, d)
    W.write_canonical(series, folder, "city")
    W.write_canonical(series.limit(10), folder, "other")
    W.write_canonical(series.where("NOT zone_id LIKE '%-3'"), folder, "city")
    return W.read_canonical(spark, folder, "city").groupBy("zone_id").agg(F.count("*").alias("rows"), F.max("energy_price").alias("highest"))


_SCHEDULE = 'SELECT zone_id, origin, "window", h AS timestamp, 0.5e0 + "window" / 10 AS price, 0.5e0 + "window" / 10 - mean_energy_price AS price_difference, (0.5e0 + "window" / 10 - mean_energy_price) / mean_energy_price * 100 AS price_difference_pct FROM (SELECT *, unnest(generate_series(window_start, window_end, INTERVAL 1 HOUR)) AS h FROM stress)'


@query("sink_price_schedule", _SCHEDULE, _WINDOWS, "price price_difference price_difference_pct")
def sink_schedule(spark, d):
    folder = shared_folder(spark)
    rows = windows(spark, d).withColumn("proposed_energy_price", 0.5 + _C("window") / 10)
    W.price_schedule(rows).select("zone_id", "origin", "window", "timestamp", _C("proposed_energy_price").alias("price"), "price_difference", "price_difference_pct").write.parquet(folder)
    return spark.read.parquet(folder)


@query("sink_review_packet", """SELECT zone_id, origin, 'zone' AS row_type, CAST(NULL AS BIGINT) AS "window", (['Low', 'Medium', 'High', 'Extremely High'])[max(list_position(['Low', 'Medium', 'High', 'Extremely High'], load_stress_level))] AS load_stress_level, CAST(NULL AS VARCHAR) AS rater_1_score, CAST(NULL AS VARCHAR) AS rater_1_comment FROM stress GROUP BY ALL
    UNION ALL SELECT zone_id, origin, 'window', "window", load_stress_level, NULL, NULL FROM stress""", _WINDOWS)
def sink_review(spark, d):
    folder, rows = shared_folder(spark), windows(spark, d)
    zones = A.zone_stress(rows, ["zone_id", "origin"]).select("zone_id", "origin", "load_stress_level")
    W.review_packet(zones, rows.select("zone_id", "origin", "window", "load_stress_level")).write.parquet(folder)
    return spark.read.parquet(folder)


@query("sink_eval_tables", """SELECT *, '{"rows":' || rows || ',"signature":"' || signature || '"}' AS detail FROM (SELECT run, zone, "window", sha256(string_agg(h, chr(10) ORDER BY part)) AS signature, CAST(sum(n) AS BIGINT) AS rows FROM (
    SELECT run, zone, "window", substr(h, 1, 2) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM (SELECT run, zone, "window", sha256('{"round":' || round || ',"load_kwh":' || load_kwh || '}') AS h FROM window_rounds) GROUP BY ALL) GROUP BY run, zone, "window")""", X.ROUNDS)
def eval_tables(spark, d):
    """Nested cells become JSON text; a table without rows isn't written."""
    folder = shared_folder(spark)
    nested = E.signatures(X.window_rounds(spark, d), _WK, ["round", "load_kwh"]).withColumn("detail", F.struct("rows", "signature"))
    W.write_tables({"signatures": nested, "empty": nested.limit(0)}, folder)
    return spark.read.parquet(f"{folder}/*")

"""Queries over zone features, windows over hours, and selection."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import features as A
from ..operators import prepare as P
from ..registry import query
from ..session import checkpoint
from .prepare import _CENTROIDS, _NEAR, _O, _centroids, origin, proposal_windows

_C = F.col
_DIV = "CASE WHEN {1} <> 0 THEN coalesce({0} / {1}, 0) ELSE 0 END"
_PARTS = {"morning": "h BETWEEN 7 AND 10", "noon": "h BETWEEN 11 AND 14", "evening": "h BETWEEN 17 AND 22", "night": "h >= 20 OR h <= 6"}
_LOAD_SQL = "SELECT zone_id, m AS mean_load_kwh, mx AS peak_load_kwh, " + f"{_DIV.format('sd', 'm')} AS load_cv, {_DIV.format('p99', 'm')} AS burstiness_p99_mean, " + ", ".join(f"{_DIV.format(n, 'm')} AS {n}_ratio" for n in _PARTS) + f", {_DIV.format('we', 'wd')} AS weekend_ratio FROM (SELECT zone_id, avg(load_kwh) AS m, max(load_kwh) AS mx, stddev_samp(load_kwh) AS sd, quantile_cont(load_kwh, 0.99) AS p99, " + ", ".join(f"avg(load_kwh) FILTER ({c}) AS {n}" for n, c in _PARTS.items()) + ", avg(load_kwh) FILTER (isodow(timestamp) > 5) AS we, avg(load_kwh) FILTER (isodow(timestamp) <= 5) AS wd FROM (SELECT *, extract(hour FROM timestamp) AS h FROM zone_hourly) GROUP BY zone_id)"
_LOAD_NAMES = "mean_load_kwh peak_load_kwh load_cv burstiness_p99_mean morning_ratio noon_ratio evening_ratio night_ratio weekend_ratio"


@query("agg_load_features", _LOAD_SQL, X.HOURLY, _LOAD_NAMES)
def load_features(spark, d):
    return A.load_features(X.zone_hourly(spark, d))


@query("agg_price_features", "SELECT zone_id, coalesce(avg(p), 0) AS mean_service_price, coalesce(stddev_samp(p), 0) AS service_price_std, coalesce(min(p), 0) AS historical_min_service_price, coalesce(max(p), 0) AS historical_max_service_price FROM (SELECT zone_id, nullif(service_price - 0.3e0, 0) AS p FROM zone_series) GROUP BY zone_id", X.SERIES, "mean_service_price service_price_std historical_min_service_price historical_max_service_price")
def price_features(spark, d):
    return A.price_features(X.zone_series(spark, d).withColumn("service_price", _C("service_price") - 0.3), "service_price", "service", bounds=True)


_PROFILE = "SELECT zone_id, count(*) AS station_count, avg(longitude) AS longitude, avg(latitude) AS latitude, CAST(sum(charge_count) AS BIGINT) AS charge_count, arg_min(area, station_id) AS area, arg_min(perimeter, station_id) AS perimeter, sum(charge_count) * 11e0 AS capacity_kw_proxy FROM stations GROUP BY zone_id"


@query("agg_station_profile", _PROFILE, X.STATIONS, "longitude latitude")
def station_profile(spark, d):
    return A.station_profile(X.stations(spark, d))


@query("join_profile", f"""SELECT s.zone_id, station_count, area / 1000000 AS area_sq_km, coalesce(food, 0) AS poi_food, coalesce(food, 0) / nullif(area / 1000000, 0) AS poi_food_density, coalesce(peak_load_kwh, 0) AS peak_load_kwh, coalesce(peak_load_kwh / nullif(capacity_kw_proxy, 0), 0) AS peak_capacity_ratio
    FROM ({_PROFILE}) s LEFT JOIN (SELECT zone_id, count(*) FILTER (contains(primary_types, 'food')) AS food FROM near GROUP BY zone_id) USING (zone_id)
    LEFT JOIN (SELECT 'z' || (row_number() OVER (ORDER BY zone_id) - 1) AS zone_id, max(load_kwh) AS peak_load_kwh FROM zone_hourly h GROUP BY h.zone_id) USING (zone_id)""", f"{X.HOURLY}, {_CENTROIDS}, {_NEAR.format('1')}", "area_sq_km poi_food_density peak_capacity_ratio")
def profile(spark, d):
    points = X.poi(spark, d).withColumnRenamed("poi_id", "point_id")
    food = P.nearest_centroid(points, _centroids(spark, d)).join(points, "point_id").groupBy("zone_id").agg(F.count_if(_C("primary_types").contains("food")).alias("food"))
    peaks = X.zone_hourly(spark, d).groupBy("zone_id").agg(F.max("load_kwh").alias("peak_load_kwh"))
    peaks = peaks.select(F.concat(F.lit("z"), (F.row_number().over(Window.orderBy("zone_id")) - 1).cast("string")).alias("zone_id"), "peak_load_kwh")
    out = A.station_profile(X.stations(spark, d)).join(food, "zone_id", "left").join(peaks, "zone_id", "left").fillna({"food": 0, "peak_load_kwh": 0.0})
    area = _C("area") / 1_000_000
    return out.select("zone_id", "station_count", area.alias("area_sq_km"), _C("food").alias("poi_food"), F.try_divide("food", F.nullif(area, F.lit(0.0))).alias("poi_food_density"), "peak_load_kwh", F.coalesce(F.try_divide("peak_load_kwh", "capacity_kw_proxy"), F.lit(0.0)).alias("peak_capacity_ratio"))


_SLOT = "time_bucket(INTERVAL 3 HOUR, timestamp, TIMESTAMP '2024-01-01')"
_POLICY = f"policy AS (SELECT zone_id, count(*) AS windows, min(load) AS low_kwh, max(load) AS high_kwh FROM (SELECT zone_id, {_SLOT} AS slot, CAST(sum(CAST(load_kwh AS DECIMAL(18, 2))) AS DOUBLE) AS load FROM zone_series WHERE timestamp < {_O} GROUP BY ALL) GROUP BY zone_id)"


def policy(spark, d, series=None):
    return A.load_policy(X.zone_series(spark, d) if series is None else series, origin())


@query("agg_3h_load_policy", "SELECT zone_id, windows, low_kwh, high_kwh, high_kwh - low_kwh AS range_kwh, low_kwh + (high_kwh - low_kwh) * 0.35e0 AS low_medium_kwh, low_kwh + (high_kwh - low_kwh) * 0.8e0 AS medium_high_kwh, low_kwh + (high_kwh - low_kwh) * 0.9e0 AS high_extreme_kwh FROM policy", f"{X.SERIES}, {_POLICY}", "range_kwh low_medium_kwh medium_high_kwh high_extreme_kwh")
def load_policy(spark, d):
    return policy(spark, d)


_CHANGES = f"""slots AS (SELECT zone_id, {_SLOT} AS slot, avg(energy_price) AS price FROM zone_series GROUP BY ALL),
changes AS (SELECT a.zone_id, a.slot, abs((a.price - b.price) / b.price) * 100 AS change_pct FROM slots a JOIN slots b ON a.zone_id = b.zone_id AND a.slot = b.slot + INTERVAL 3 HOUR WHERE b.price > 0)"""


@query("agg_price_change_reference", "SELECT quantile_cont(change_pct, 0.95) AS p95_pct, count(*) AS observations, count(*) FILTER (change_pct > 0) AS nonzero_observations FROM changes", f"{X.SERIES}, {_CHANGES}", "p95_pct")
def price_change_reference(spark, d):
    return A.price_reference(A.price_changes(X.zone_series(spark, d)))


@query("win_percentile_of", "SELECT zone_id, position, shift_pct, round((SELECT count(*) FROM changes WHERE round(change_pct, 8) <= abs(shift_pct)) * 100e0 / (SELECT count(*) FROM changes), 4) AS percentile, abs(shift_pct) > (SELECT round(quantile_cont(change_pct, 0.95), 8) FROM changes) AS exceeds_p95 FROM (SELECT zone_id, position, CAST(position % 80 - 40 AS DOUBLE) AS shift_pct FROM wins)", f"{X.SERIES}, {_CHANGES}, wins AS (SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) AS position FROM zone_series WHERE timestamp >= {_O} AND hour % 3 = 0)")
def percentile_of(spark, d):
    asked = proposal_windows(spark, d).select("zone_id", _C("position").cast("long").alias("position"), (_C("position") % 80 - 40).cast("double").alias("shift_pct"))
    return A.percentile_of(asked, "shift_pct", A.price_changes(X.zone_series(spark, d)))


@query("agg_weather_by_time", "SELECT timestamp, arg_min(temperature, zone_id) AS temperature, arg_min(humidity, zone_id) AS humidity FROM (SELECT timestamp, zone_id, CASE WHEN length(zone_id) % 2 = 0 THEN temperature END AS temperature, humidity FROM zone_series) GROUP BY timestamp", X.SERIES)
def weather_by_time(spark, d):
    known = F.when(F.length("zone_id") % 2 == 0, _C("temperature"))
    rows = X.zone_series(spark, d).withColumn("temperature", known)
    first = lambda c: F.min_by(c, F.when(_C(c).isNotNull(), _C("zone_id"))).alias(c)
    return rows.groupBy("timestamp").agg(first("temperature"), first("humidity"))


@query("agg_diurnal_profile", "SELECT z.zone_id, CAST(h AS INTEGER) AS hour, coalesce(m, z.mean) AS diurnal_kwh FROM (SELECT zone_id, avg(load_kwh) AS mean FROM part GROUP BY zone_id) z CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT zone_id, extract(hour FROM timestamp) AS h, avg(load_kwh) AS m FROM part GROUP BY ALL) p USING (zone_id, h)", f"{X.HOURLY}, part AS (SELECT * FROM zone_hourly WHERE extract(hour FROM timestamp) <> 3)", "diurnal_kwh")
def diurnal_profile(spark, d):
    return A.diurnal_profile(X.zone_hourly(spark, d).where(F.hour("timestamp") != 3))


@query("agg_daily_totals", "SELECT z.zone_id, strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(sum(CAST(load_kwh AS DECIMAL(18, 2))), 0) AS DOUBLE) AS load_kwh FROM (SELECT DISTINCT zone_id FROM zone_hourly) z CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS day) LEFT JOIN zone_hourly h ON h.zone_id = z.zone_id AND date_trunc('day', h.timestamp) = day GROUP BY ALL", X.HOURLY)
def daily_totals(spark, d):
    rows = X.zone_hourly(spark, d)
    days = X.hours(spark).select(_C("timestamp").cast("date").alias("day")).distinct()
    sums = rows.groupBy("zone_id", _C("timestamp").cast("date").alias("day")).agg(F.sum(_C("load_kwh").cast("decimal(18,2)")).alias("s"))
    return rows.select("zone_id").distinct().crossJoin(F.broadcast(days)).join(sums, ["zone_id", "day"], "left").select("zone_id", _C("day").cast("string").alias("day"), F.coalesce(_C("s").cast("double"), F.lit(0.0)).alias("load_kwh"))


@query("agg_hourly_shape", "SELECT zone_id, " + ", ".join(f"coalesce(avg(m) FILTER ({c}), 0) AS {n}" for n, c in zip(("morning_7_10", "noon_11_14", "evening_17_22", "night_20_6"), _PARTS.values())) + " FROM (SELECT zone_id, extract(hour FROM timestamp) AS h, avg(load_kwh) AS m FROM zone_hourly GROUP BY ALL) GROUP BY zone_id", X.HOURLY, "morning_7_10 noon_11_14 evening_17_22 night_20_6")
def hourly_shape(spark, d):
    return A.hourly_shape(X.zone_hourly(spark, d))


@query("agg_context_summaries", "SELECT zone_id, avg(nullif(energy_price, 0)) AS mean_price, min(nullif(energy_price, 0)) AS min_price, max(energy_price) AS max_price, avg(occupancy) AS mean_occupancy, max(occupancy) AS max_occupancy, avg(temperature) AS mean_temp_c, avg(humidity) AS mean_humidity, count(*) FILTER (rain > 0) AS rain_hours, sum(rain) AS total_rain FROM zone_series GROUP BY zone_id", X.SERIES, "mean_price mean_occupancy max_occupancy mean_temp_c mean_humidity")
def context_summaries(spark, d):
    price = F.nullif(_C("energy_price"), F.lit(0.0))
    return X.zone_series(spark, d).groupBy("zone_id").agg(
        F.avg(price).alias("mean_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.avg("occupancy").alias("mean_occupancy"), F.max("occupancy").alias("max_occupancy"),
        F.avg("temperature").alias("mean_temp_c"), F.avg("humidity").alias("mean_humidity"), F.count_if(_C("rain") > 0).alias("rain_hours"), F.sum("rain").alias("total_rain"),
    )


_ELIGIBLE = f"""SELECT z.zone_id, o.origin, count(load_kwh) FILTER (timestamp < origin) AS past_hours, count(load_kwh) FILTER (timestamp >= origin) AS future_hours,
    array_to_string(list_filter([CASE WHEN count(load_kwh) FILTER (timestamp < origin) < 168 THEN 'incomplete_history' END, CASE WHEN count(load_kwh) FILTER (timestamp >= origin) < 24 THEN 'incomplete_horizon' END,
    CASE WHEN coalesce(count(DISTINCT load_kwh) FILTER (timestamp < origin), 0) < 2 THEN 'constant_load' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT DISTINCT zone_id FROM zone_hourly) z CROSS JOIN (SELECT unnest(generate_series({_O}, {_O} + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS origin) o LEFT JOIN zone_hourly h ON h.zone_id = z.zone_id AND timestamp >= origin - INTERVAL 7 DAY AND timestamp < origin + INTERVAL 1 DAY GROUP BY ALL"""


def _eligibility(spark, d):
    """Days first: each hour belongs to several origins, so what is joined with them is summed up by day."""
    days = X.zone_hourly(spark, d).groupBy("zone_id", _C("timestamp").cast("date").alias("day")).agg(F.count("load_kwh").alias("n"), F.min("load_kwh").alias("low"), F.max("load_kwh").alias("high"))
    origins = spark.range(4).select((origin() + F.make_dt_interval(days=_C("id").cast("int"))).alias("origin"))
    first = _C("origin").cast("date")
    grid = days.select("zone_id").distinct().crossJoin(F.broadcast(origins)).withColumn("day", F.explode(F.sequence(F.date_sub(first, 7), first)))
    past = _C("day") < first
    got = grid.join(days, ["zone_id", "day"], "left").groupBy("zone_id", "origin").agg(
        F.coalesce(F.sum(F.when(past, _C("n"))), F.lit(0)).alias("past_hours"), F.coalesce(F.sum(F.when(~past, _C("n"))), F.lit(0)).alias("future_hours"),
        F.coalesce(F.min(F.when(past, _C("low"))) < F.max(F.when(past, _C("high"))), F.lit(False)).alias("varies"),
    )
    reasons = F.array_compact(F.array(F.when(_C("past_hours") < 168, "incomplete_history"), F.when(_C("future_hours") < 24, "incomplete_horizon"), F.when(~_C("varies"), "constant_load")))
    return got.select("zone_id", "origin", "past_hours", "future_hours", F.array_join(reasons, ",").alias("reasons"))


@query("agg_zone_eligibility", _ELIGIBLE, X.HOURLY)
def zone_eligibility(spark, d):
    return _eligibility(spark, d)


@query("agg_eligibility_report", f"SELECT zone_id, bool_and(reasons = '') AS eligible, '[' || string_agg('{{\"origin\":\"' || strftime(origin, '%Y-%m-%d') || '\",\"reasons\":\"' || reasons || '\"}}', ',' ORDER BY origin) || ']' AS detail FROM ({_ELIGIBLE}) GROUP BY zone_id", X.HOURLY)
def eligibility_report(spark, d):
    detail = F.to_json(F.sort_array(F.collect_list(F.struct(F.date_format("origin", "yyyy-MM-dd").alias("origin"), "reasons"))))
    return _eligibility(spark, d).groupBy("zone_id").agg(F.bool_and(_C("reasons") == "").alias("eligible"), detail.alias("detail"))


_COMPLETE = """days AS (SELECT day, count(*) FILTER (n = 24) = (SELECT count(DISTINCT zone_id) FROM zone_series) AS whole FROM (SELECT zone_id, CAST(timestamp AS DATE) AS day, count(DISTINCT timestamp) AS n FROM zone_series WHERE load_kwh >= 0 GROUP BY ALL) GROUP BY day),
spans AS (SELECT o.day FROM days o JOIN days d ON d.day BETWEEN o.day - 7 AND o.day + 1 WHERE d.whole GROUP BY o.day HAVING count(*) = 9)"""


@query("agg_even_origins", "SELECT k AS pick, CAST(day AS VARCHAR) AS day FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM spans) JOIN (SELECT unnest(range(1, 6)) AS k) ON pos = k * n // 6", f"{X.SERIES}, {_COMPLETE}")
def even_origins(spark, d):
    """Five interior origins, evenly spaced over those whose week before and two days from then on are complete in every zone."""
    got = A.even_origins(X.zone_series(spark, d).where("load_kwh >= 0"), 5, history_days=7, horizon_days=2)
    return got.select(_C("pick"), _C("origin").cast("date").cast("string").alias("day"))


@query("agg_feature_manifest", "SELECT count(*) AS rows, count(DISTINCT zone_id) AS zones, min(timestamp) AS first, max(timestamp) AS last, 'humidity,occupancy,rain,service_price,temperature' AS present, 'battery' AS missing FROM zone_series", X.SERIES)
def feature_manifest(spark, d):
    s = X.zone_series(spark, d)
    optional = ["battery", "humidity", "occupancy", "rain", "service_price", "temperature"]
    there = ",".join(c for c in optional if c in s.columns)
    lacking = ",".join(c for c in optional if c not in s.columns)
    return s.agg(F.count("*").alias("rows"), F.count_distinct("zone_id").alias("zones"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.lit(there).alias("present"), F.lit(lacking).alias("missing"))


@query("agg_numeric_summary", """SELECT zone_id, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / sqrt(count(value)) AS sem, min(value) AS min, max(value) AS max
    FROM (SELECT zone_id, unnest(['load_kwh', 'energy_price', 'occupancy']) AS metric, unnest([load_kwh, energy_price, occupancy]) AS value FROM zone_series) GROUP BY ALL""", X.SERIES, "mean std sem min max")
def numeric_summary(spark, d):
    return summary(X.zone_series(spark, d), ["zone_id"], ["load_kwh", "energy_price", "occupancy"])


def summary(df, keys, metrics):
    """Long summary of metrics by group."""
    long = df.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")
    v = _C("value")
    return long.groupBy(*keys, "metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.min(v).alias("min"), F.max(v).alias("max"))


_W = "PARTITION BY zone_id ORDER BY timestamp"


@query("win_lags", f"SELECT * FROM (SELECT zone_id, timestamp, load_kwh, lag(load_kwh, 1) OVER ({_W}) AS lag_1, lag(load_kwh, 24) OVER ({_W}) AS lag_24 FROM zone_series) WHERE lag_1 IS NOT NULL AND lag_24 IS NOT NULL", X.SERIES)
def win_lags(spark, d):
    return A.lags(X.zone_series(spark, d).select("zone_id", "timestamp", "load_kwh"), "load_kwh", [1, 24]).where("lag_1 IS NOT NULL AND lag_24 IS NOT NULL")


@query("win_rolling_stats", "SELECT zone_id, timestamp, " + ", ".join(f"CASE WHEN n > {n} THEN avg(load_kwh) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS mean_{n}, CASE WHEN n > {n} THEN stddev_pop(load_kwh) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS std_{n}" for n in (24, 168)) + f" FROM (SELECT *, row_number() OVER ({_W}) AS n FROM zone_series)", X.SERIES, "mean_24 std_24 mean_168 std_168")
def win_rolling(spark, d):
    return A.rolling(X.zone_series(spark, d), "load_kwh", [24, 168]).select("zone_id", "timestamp", "mean_24", "std_24", "mean_168", "std_168")


_SEG = f"segs AS (SELECT zone_id, timestamp, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, CASE WHEN timestamp = lag(timestamp) OVER ({_W}) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM zone_hourly))"


@query("win_segments", "SELECT zone_id, CAST(segment AS BIGINT) AS segment, min(timestamp) AS start, max(timestamp) + INTERVAL 1 HOUR AS end, count(*) AS hours FROM segs GROUP BY zone_id, segment", f"{X.HOURLY}, {_SEG}")
def win_segments(spark, d):
    return A.segment_intervals(X.zone_hourly(spark, d))


_TARGETS = "targets AS (SELECT zone_id, timestamp, segment FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, segment ORDER BY timestamp) - 1 AS pos, count(*) OVER (PARTITION BY zone_id, segment) AS size FROM segs) WHERE pos >= 3 AND pos + 2 <= size AND (pos - 3) % 2 = 0)"


@query("win_complete_targets", "SELECT zone_id, timestamp, CAST(segment AS BIGINT) AS segment FROM targets", f"{X.HOURLY}, {_SEG}, {_TARGETS}")
def win_targets(spark, d):
    return A.complete_targets(X.zone_hourly(spark, d), past=3, ahead=2, stride=2)


@query("win_train_split", """SELECT zone_id, timestamp, CASE WHEN pos >= cut THEN 'validation' WHEN coalesce(timestamp + INTERVAL 24 HOUR <= min(CASE WHEN pos >= cut THEN timestamp END) OVER (PARTITION BY zone_id), true) THEN 'train' ELSE 'purged' END AS role
    FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) - 1 AS pos, greatest(1, least(count(*) OVER (PARTITION BY zone_id) - 1, floor(count(*) OVER (PARTITION BY zone_id) * 0.8e0))) AS cut FROM targets)""", f"{X.HOURLY}, {_SEG}, {_TARGETS}")
def win_split(spark, d):
    return A.train_split(A.complete_targets(X.zone_hourly(spark, d), past=3, ahead=2, stride=2), ratio=0.8, ahead=24)


@query("win_fill", f"SELECT zone_id, timestamp, coalesce(last_value(occupancy IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), first_value(occupancy IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), avg(occupancy) OVER (PARTITION BY zone_id), 0) AS occupancy FROM zone_series", X.SERIES, "occupancy")
def win_fill(spark, d):
    return A.filled(X.zone_series(spark, d).select("zone_id", "timestamp", "occupancy"), ["occupancy"])


@query("win_latest_n", "SELECT zone_id, timestamp, load_kwh FROM zone_hourly QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY timestamp DESC) <= 24", X.HOURLY)
def win_latest(spark, d):
    return A.latest(X.zone_hourly(spark, d).select("zone_id", "timestamp", "load_kwh"), 24)


_FEATURES = sorted({f for w in A.CATEGORY_WEIGHTS.values() for f in w})
_BASE = f"""base AS (SELECT *, 1 - abs(weekend_ratio - 1) AS weekend_evenness, CAST(length(zone_id) + (row_number() OVER (ORDER BY zone_id)) % 7 AS DOUBLE) AS charge_count, mean_load_kwh / 10 AS poi_business_density,
    peak_load_kwh / 7 AS poi_food_density, load_cv * 3 AS poi_lifestyle_density FROM ({_LOAD_SQL}))"""
_SCORES = f"""{X.HOURLY}, {_BASE}, ends AS (SELECT {", ".join(f"quantile_cont({f}, 0.05) AS {f}_a, quantile_cont({f}, 0.95) AS {f}_b" for f in _FEATURES)} FROM base),
cut AS (SELECT zone_id, {", ".join(f"least({f}_b, greatest({f}_a, {f})) AS {f}" for f in _FEATURES)} FROM base, ends),
z AS (SELECT zone_id, {", ".join(f"coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0) AS {f}" for f in _FEATURES)} FROM cut)"""


def profiles(spark, d):
    base = A.load_features(X.zone_hourly(spark, d))
    number = F.row_number().over(Window.orderBy("zone_id"))
    return base.withColumns({"charge_count": (F.length("zone_id") + number % 7).cast("double"), "poi_business_density": _C("mean_load_kwh") / 10, "poi_food_density": _C("peak_load_kwh") / 7, "poi_lifestyle_density": _C("load_cv") * 3})


_SCORE_COLUMNS = ", ".join("{} AS {}".format(" + ".join(f"{w}e0 * {f}" for f, w in ws.items()), n) for n, ws in zip(("cbd", "residential", "transport", "commercial", "industrial"), A.CATEGORY_WEIGHTS.values()))


@query("top_zone_scores", f"SELECT zone_id, {_SCORE_COLUMNS} FROM z", _SCORES, "cbd residential transport commercial industrial")
def zone_scores(spark, d):
    names = dict(zip(A.CATEGORY_WEIGHTS, ("cbd", "residential", "transport", "commercial", "industrial")))
    return A.zone_scores(profiles(spark, d)).withColumnsRenamed(names)


_NAMES = ("cbd", "residential", "transport", "commercial", "industrial")
_BEST = ", ".join(f"best_{n} AS (SELECT zone_id, {n} AS s FROM scores ORDER BY {n} DESC, zone_id LIMIT 5)" for n in _NAMES)
_CHOICE = f"choice AS (SELECT {', '.join(f'best_{n}.zone_id AS z_{n}, best_{n}.s AS s_{n}' for n in _NAMES)} FROM {', '.join(f'best_{n}' for n in _NAMES)} WHERE len(list_distinct([{', '.join(f'best_{n}.zone_id' for n in _NAMES)}])) = 5 ORDER BY {' + '.join(f'best_{n}.s' for n in _NAMES)} DESC LIMIT 1)"


@query("top_category_assignment", " UNION ALL ".join(f"SELECT '{c}' AS category, z_{n} AS zone_id, s_{n} AS score FROM choice" for n, c in zip(_NAMES, A.CATEGORY_WEIGHTS)), f"{_SCORES}, scores AS (SELECT zone_id, {_SCORE_COLUMNS} FROM z), {_BEST}, {_CHOICE}", "score")
def category_assignment(spark, d):
    return spark.createDataFrame(A.assigned_categories(checkpoint(A.zone_scores(profiles(spark, d)))), "category string, zone_id string, score double")


_PICKED = f"""ranked AS (SELECT zone_id, row_number() OVER (ORDER BY mean_load_kwh, load_cv, peak_load_kwh, zone_id) - 1 AS place, count(*) OVER () AS n FROM base),
reasons AS ({" UNION ALL ".join(f"SELECT 0 AS pri, {i} AS i, z_{n} AS zone_id FROM choice" for i, n in enumerate(_NAMES))}
    UNION ALL SELECT 1, i, zone_id FROM ranked JOIN (SELECT unnest(range(9)) AS i) ON place = round_even(i * (n - 1) / 8e0, 0) UNION ALL SELECT 2, place, zone_id FROM ranked),
firsts AS (SELECT zone_id, min(pri * 1000000 + i) AS b FROM reasons GROUP BY zone_id)"""


@query("top_representative", "SELECT * FROM (SELECT zone_id, row_number() OVER (ORDER BY b) - 1 AS position, (['category', 'rank', 'fill'])[b // 1000000 + 1] AS reason FROM firsts) WHERE position < 9", f"{_SCORES}, scores AS (SELECT zone_id, {_SCORE_COLUMNS} FROM z), {_BEST}, {_CHOICE}, {_PICKED}")
def representative(spark, d):
    """Nine zones: those of the categories, then evenly spaced ranks of a sort by four keys."""
    return A.representative_zones(profiles(spark, d), 9)


@query("top_random_zones", "SELECT DISTINCT zone_id FROM zone_hourly ORDER BY md5('20240101-' || zone_id), zone_id LIMIT 6", X.HOURLY)
def random_zones(spark, d):
    """A seeded sample: the same zones for the same seed, whatever the partitions."""
    return X.zone_hourly(spark, d).select("zone_id").distinct().orderBy(F.md5(F.concat(F.lit("20240101-"), "zone_id")), "zone_id").limit(6)

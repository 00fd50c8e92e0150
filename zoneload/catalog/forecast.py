"""Queries over forecasts."""

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import features as A
from ..plans import forecast as C
from ..plans import pooled as M
from ..registry import query
from ..session import checkpoint, kept
from .features import _POLICY, policy
from .prepare import _O, origin

_C = F.col
DAYS = 14
_ORIGINS = f"origins AS (SELECT unnest([{_O}, {_O} + INTERVAL 2 DAY, {_O} + INTERVAL 4 DAY]) AS origin)"


def ar_views(name, history, target, price="energy_price"):
    """The oracle's forecast: history and target rows (with origin) to ``name`` (base_kwh, adjustment_kwh, raw_kwh)."""
    return f"""{name}_hours AS (SELECT zone_id, origin, hour, avg(load_kwh) AS hl, avg(energy_price) AS hp FROM {history} GROUP BY ALL),
{name}_mean AS (SELECT zone_id, origin, avg(greatest(load_kwh, 0)) AS ml, avg(nullif(energy_price, 0)) AS mp, sum(CASE WHEN timestamp >= origin - INTERVAL 1 DAY THEN load_kwh END) AS last, sum(load_kwh) / count(DISTINCT CAST(timestamp AS DATE)) AS daily FROM {history} GROUP BY ALL),
{name}_fit AS (SELECT zone_id, origin, sum((energy_price - hp) * (load_kwh - hl)) AS cov, sum((energy_price - hp) ** 2) AS var FROM {history} JOIN {name}_hours USING (zone_id, origin, hour) GROUP BY ALL),
{name}_response AS (SELECT zone_id, origin, round(greatest(-0.3e0 * ml / mp, least(0, CASE WHEN var > 1e-12 AND cov / var < 0 THEN cov / var ELSE -0.1e0 * ml / mp END)), 6) AS slope, round(ml + 1e-9, 4) AS ml, round(mp + 1e-9, 6) AS mp FROM {name}_mean JOIN {name}_fit USING (zone_id, origin)),
{name}_base AS (SELECT t.zone_id, t.origin, t.timestamp, t.hour, t.{price} AS energy_price, t.load_kwh AS actual_kwh, t.occupancy, t.service_price, t.temperature, t.humidity, t.rain, greatest(0, CASE WHEN w.load_kwh IS NULL THEN hl ELSE 0.72e0 * w.load_kwh + 0.28e0 * hl END * CASE WHEN daily = 0 THEN 1 ELSE greatest(0.75e0, least(1.25e0, last / daily)) END) AS base_kwh
    FROM {target} t LEFT JOIN {history} w ON w.zone_id = t.zone_id AND w.origin = t.origin AND w.timestamp = t.timestamp - INTERVAL 7 DAY JOIN {name}_hours h ON h.zone_id = t.zone_id AND h.origin = t.origin AND h.hour = t.hour JOIN {name}_mean m ON m.zone_id = t.zone_id AND m.origin = t.origin),
{name} AS (SELECT *, greatest(0, base_kwh + adjustment_kwh) AS raw_kwh FROM (SELECT b.*, greatest(-lim, least(lim, slope * (energy_price - hp))) AS adjustment_kwh FROM (SELECT b.*, slope, hp, greatest(base_kwh * 0.3e0, greatest(ml * 0.05e0, 1e-9)) AS lim
    FROM {name}_base b JOIN {name}_response r USING (zone_id, origin) JOIN {name}_hours h USING (zone_id, origin, hour)) b))"""


HIST = f"""{_ORIGINS}, hist AS (SELECT origin, s.* FROM zone_series s JOIN origins ON timestamp >= origin - INTERVAL 14 DAY AND timestamp < origin),
ahead AS (SELECT origin, s.* FROM zone_series s JOIN origins ON timestamp >= origin AND timestamp < origin + INTERVAL 1 DAY)"""
AR = f"{X.SERIES}, {HIST}, {ar_views('ar', 'hist', 'ahead')}"


def origins(spark, n=3):
    return spark.range(n).select((origin() + F.make_dt_interval(days=(_C("id") * 2).cast("int"))).cast("timestamp_ntz").alias("origin"))


@query("join_zone_model_frame", "SELECT h.zone_id, timestamp, h.load_kwh AS actual_kwh, s.energy_price AS e_price, s.service_price AS s_price, h.occupancy, w.temperature, w.humidity, w.rain FROM zone_hourly h LEFT JOIN zone_series s USING (zone_id, timestamp) LEFT JOIN weather w USING (timestamp)", X.SERIES, "occupancy")
def model_frame(spark, d):
    prices = X.zone_series(spark, d).select("zone_id", "timestamp", _C("energy_price").alias("e_price"), _C("service_price").alias("s_price"))
    return X.zone_hourly(spark, d).withColumnRenamed("load_kwh", "actual_kwh").join(prices, ["zone_id", "timestamp"], "left").join(F.broadcast(X.weather(spark)), "timestamp", "left")


@query("join_lag_week", "SELECT a.zone_id, a.timestamp, a.load_kwh, b.load_kwh AS lag_week FROM zone_hourly a LEFT JOIN zone_hourly b ON a.zone_id = b.zone_id AND b.timestamp = a.timestamp - INTERVAL 7 DAY", X.HOURLY)
def lag_week(spark, d):
    rows = X.zone_hourly(spark, d).select("zone_id", "timestamp", "load_kwh")
    before = rows.select("zone_id", (_C("timestamp") + F.expr("interval 7 days")).alias("timestamp"), _C("load_kwh").alias("lag_week"))
    return rows.join(before, ["zone_id", "timestamp"], "left")


@query("join_price_schedule", f"SELECT s.zone_id, s.timestamp, p.price AS energy_price, p.price IS NULL OR p.price < 0 OR p.n > 1 AS invalid FROM (SELECT * FROM zone_series WHERE timestamp >= {_O}) s LEFT JOIN (SELECT zone_id, timestamp, max(energy_price * 1.1e0 - CASE WHEN hour = 4 THEN 9 ELSE 0 END) AS price, count(*) * CASE WHEN any_value(hour) = 9 THEN 2 ELSE 1 END AS n FROM zone_series WHERE hour <> 13 GROUP BY ALL) p USING (zone_id, timestamp)", X.SERIES, "energy_price")
def price_schedule(spark, d):
    s = X.zone_series(spark, d)
    schedule = s.where("hour <> 13").select("zone_id", "timestamp", (_C("energy_price") * 1.1 - F.when(_C("hour") == 4, 9).otherwise(0)).alias("price"), "hour")
    schedule = schedule.unionByName(schedule.where("hour = 9")).groupBy("zone_id", "timestamp").agg(F.max("price").alias("price"), F.count("*").alias("n"))
    out = s.where(_C("timestamp") >= origin()).select("zone_id", "timestamp").join(schedule, ["zone_id", "timestamp"], "left")
    return out.select("zone_id", "timestamp", _C("price").alias("energy_price"), (_C("price").isNull() | (_C("price") < 0) | (_C("n") > 1)).alias("invalid"))


@query("agg_price_response", "SELECT zone_id, origin, slope, ml AS mean_load, mp AS mean_price FROM ar_response", AR, "slope mean_load mean_price")
def price_response(spark, d):
    return C.price_response(C.at_origins(X.zone_series(spark, d), origins(spark), -DAYS, 0))


_AR_NAMES = "base_kwh adjustment_kwh raw_kwh"


@query("job_ar_forecast", "SELECT zone_id, origin, timestamp, energy_price, base_kwh, adjustment_kwh, raw_kwh FROM ar", AR, _AR_NAMES)
def ar_forecast(spark, d):
    return C.ar_forecast(X.zone_series(spark, d), origins(spark), DAYS).select("zone_id", "origin", "timestamp", "energy_price", "base_kwh", "adjustment_kwh", "raw_kwh")


@query("job_forecast_matrix", """SELECT zone_id, origin, alpha, sum(p) AS forecast_total_kwh, max(p) AS forecast_peak_kwh, count(*) AS hours, coalesce((sum(p) - any_value(previous)) / nullif(any_value(previous), 0) * 100, 0) AS predicted_change_pct
    FROM (SELECT zone_id, origin, alpha, greatest(0, (1 - alpha) * raw_kwh + alpha * hl) AS p FROM ar JOIN ar_hours USING (zone_id, origin, hour) CROSS JOIN (SELECT unnest([0e0, 0.25e0, 0.5e0, 1e0]) AS alpha))
    JOIN (SELECT zone_id, origin, sum(load_kwh) AS previous FROM hist WHERE timestamp >= origin - INTERVAL 1 DAY GROUP BY ALL) USING (zone_id, origin) GROUP BY ALL""", AR, "forecast_total_kwh forecast_peak_kwh predicted_change_pct")
def forecast_matrix(spark, d):
    series = X.zone_series(spark, d)
    return C.zone_summaries(C.forecast_matrix(series, origins(spark), DAYS, [0.0, 0.25, 0.5, 1.0]), series, origins(spark))


_CAL = f"""{X.SERIES}, {_ORIGINS},
back AS (SELECT origin AS final, b, origin - b * INTERVAL 1 DAY AS origin FROM origins, (SELECT unnest(range(4)) AS b)),
every AS (SELECT DISTINCT origin FROM back),
hist AS (SELECT origin, s.* FROM zone_series s JOIN every ON timestamp >= origin - INTERVAL 14 DAY AND timestamp < origin),
ahead AS (SELECT origin, s.* FROM zone_series s JOIN every ON timestamp >= origin AND timestamp < origin + INTERVAL 1 DAY),
frozen AS (SELECT origin, s.* FROM zone_series s JOIN origins ON timestamp >= origin - INTERVAL 17 DAY AND timestamp < origin - INTERVAL 3 DAY),
{ar_views('ar', 'hist', 'ahead')}, {ar_views('fz', 'frozen', 'ahead')},
cal AS (SELECT zone_id, final, b, timestamp, hour, actual_kwh, raw_kwh, greatest(0, 0.7e0 * raw_kwh + 0.3e0 * hl) AS blended_kwh FROM (SELECT a.*, final, b, hl, greatest(0, base_kwh + greatest(-lim, least(lim, slope * (energy_price - hp)))) AS raw_kwh FROM (
    SELECT a.zone_id, final, b, a.timestamp, a.hour, a.actual_kwh, a.base_kwh, a.energy_price, greatest(a.base_kwh * 0.3e0, greatest(ml * 0.05e0, 1e-9)) AS lim, slope, hp, hl
    FROM ar_base a JOIN back USING (origin) JOIN fz_response r ON r.zone_id = a.zone_id AND r.origin = final JOIN fz_hours h ON h.zone_id = a.zone_id AND h.origin = final AND h.hour = a.hour) a)),
bias AS (SELECT zone_id, final, hour, avg(blended_kwh - actual_kwh) AS bias FROM cal WHERE b > 0 GROUP BY ALL),
width AS (SELECT zone_id, final, quantile_cont(abs(blended_kwh - actual_kwh - bias), 0.9) AS half_width FROM cal JOIN bias USING (zone_id, final, hour) WHERE b > 0 GROUP BY ALL)"""


def _calibrated(spark, d):
    return C.calibrated_forecast(checkpoint(X.zone_series(spark, d)), origins(spark), DAYS, 3, 0.3)


@query("job_calibrated_forecast", "SELECT zone_id, final AS origin, timestamp, raw_kwh, blended_kwh, bias, greatest(0, blended_kwh - bias) AS predicted_kwh, half_width FROM cal JOIN bias USING (zone_id, final, hour) JOIN width USING (zone_id, final) WHERE b = 0", _CAL, "raw_kwh blended_kwh bias predicted_kwh half_width")
def calibrated(spark, d):
    return _calibrated(spark, d)


@query("agg_validation_bias", "SELECT zone_id, final AS origin, avg(bias) AS bias_mean, max(abs(bias)) AS bias_max_abs, any_value(half_width) AS half_width FROM bias JOIN width USING (zone_id, final) GROUP BY zone_id, final", _CAL, "bias_mean bias_max_abs half_width")
def validation_bias(spark, d):
    return _calibrated(spark, d).groupBy("zone_id", "origin").agg(F.avg("bias").alias("bias_mean"), F.max(F.abs("bias")).alias("bias_max_abs"), F.max("half_width").alias("half_width"))


_BACK = AR.replace(_ORIGINS, f"origins AS (SELECT unnest(generate_series({_O} - INTERVAL 6 DAY, {_O} + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS origin)")


@query("job_daily_backtest", "SELECT count(DISTINCT origin) AS days, count(*) AS hours, avg(abs(actual_kwh - raw_kwh)) AS mae, sqrt(avg((actual_kwh - raw_kwh) ** 2)) AS rmse, sum(abs(actual_kwh - raw_kwh)) / sum(abs(actual_kwh)) * 100 AS wape_pct FROM ar", _BACK, "mae rmse wape_pct")
def daily_backtest(spark, d):
    days = spark.range(-6, 7).select((origin() + F.make_dt_interval(days=_C("id").cast("int"))).cast("timestamp_ntz").alias("origin"))
    series = kept(X.zone_series(spark, d).select("zone_id", "timestamp", "load_kwh", "energy_price"))
    return C.daily_backtest(series, days, DAYS)


_WINDOWS = f"""{AR}, {_POLICY}, wins AS (SELECT zone_id, origin, "window", min(timestamp) AS window_start, max(timestamp) AS window_end, count(*) AS hours, avg(raw_kwh) AS mean_predicted_kwh, sum(raw_kwh) AS sum_predicted_kwh, max(raw_kwh) AS peak_predicted_kwh, sum(actual_kwh) AS sum_actual_kwh,
    avg(service_price) AS mean_service_price, avg(energy_price) AS mean_energy_price, avg(occupancy) AS mean_occupancy, avg(temperature) AS mean_temp_c, avg(humidity) AS mean_humidity, sum(rain) AS total_rain
    FROM (SELECT *, (row_number() OVER (PARTITION BY zone_id, origin ORDER BY timestamp) - 1) // 3 AS "window" FROM ar) GROUP BY ALL),
stress AS (SELECT *, CASE WHEN p < 35 THEN 'Low' WHEN p < 80 THEN 'Medium' WHEN p < 90 THEN 'High' ELSE 'Extremely High' END AS load_stress_level, CASE WHEN q < 35 THEN 'Low' WHEN q < 80 THEN 'Medium' WHEN q < 90 THEN 'High' ELSE 'Extremely High' END AS actual_level FROM (
    SELECT *, CASE WHEN high_kwh <= low_kwh THEN 50 ELSE greatest(0, (sum_predicted_kwh - low_kwh) / (high_kwh - low_kwh) * 100) END AS p, CASE WHEN high_kwh <= low_kwh THEN 50 ELSE greatest(0, (sum_actual_kwh - low_kwh) / (high_kwh - low_kwh) * 100) END AS q FROM wins JOIN policy USING (zone_id)))"""
_RANK = "list_position(['Low', 'Medium', 'High', 'Extremely High'], {})"


def windows(spark, d, n=3, raw=None, series=None):
    """Pricing windows of the forecasts of all zones and origins, with bands of prediction and actual load."""
    series = X.zone_series(spark, d) if series is None else series
    raw = (C.ar_forecast(series, origins(spark, n), DAYS) if raw is None else raw).withColumnRenamed("raw_kwh", "predicted_kwh").join(series.select("zone_id", "timestamp", _C("load_kwh").alias("actual_kwh")), ["zone_id", "timestamp"])
    return A.pricing_windows(raw, ["zone_id", "origin"], policy(spark, d, series))


@query("agg_pricing_windows", f'SELECT zone_id, origin, "window", window_start, window_end, hours, mean_predicted_kwh, sum_predicted_kwh, peak_predicted_kwh, sum_actual_kwh, mean_service_price, mean_energy_price, mean_occupancy, mean_temp_c, total_rain, p AS load_range_position_pct, load_stress_level, actual_level AS actual_load_stress_level, load_stress_level = actual_level AS stress_correct, {_RANK.format("actual_level")} > {_RANK.format("load_stress_level")} AS stress_missed FROM stress', _WINDOWS, "mean_predicted_kwh sum_predicted_kwh peak_predicted_kwh sum_actual_kwh mean_service_price mean_energy_price mean_occupancy mean_temp_c load_range_position_pct")
def pricing_windows(spark, d):
    return windows(spark, d).select("zone_id", "origin", "window", "window_start", "window_end", "hours", "mean_predicted_kwh", "sum_predicted_kwh", "peak_predicted_kwh", "sum_actual_kwh", "mean_service_price", "mean_energy_price", "mean_occupancy", "mean_temp_c", "total_rain", "load_range_position_pct", "load_stress_level", "actual_load_stress_level", "stress_correct", "stress_missed")


@query("agg_zone_stress", f"SELECT zone_id, origin, (['Low', 'Medium', 'High', 'Extremely High'])[max({_RANK.format('load_stress_level')})] AS load_stress_level, max(sum_predicted_kwh) AS stress_load_kwh, max(p) AS max_position_pct FROM stress GROUP BY zone_id, origin", _WINDOWS, "stress_load_kwh max_position_pct")
def zone_stress(spark, d):
    return A.zone_stress(windows(spark, d), ["zone_id", "origin"])


@query("win_supervised")
def supervised(spark, d):
    return C.supervised_windows(X.zone_series(spark, d), 168, 24, ["energy_price", "temperature"], stride=1, train_end=origin())


_TERMS = ["energy_price", "temperature"]


def _pooled_parts(spark, d):
    """The series with categories, one of them constant in a zone: before two days to go, those, and the day after."""
    kind = F.element_at(F.split("zone_id", "-"), 1)
    series = X.zone_series(spark, d).withColumns({"kind": kind, "tariff": F.when(_C("hour") < 7, "night").when(_C("hour") < 17, "day").otherwise("peak")})
    day = F.expr("interval 1 day")
    return series.where(_C("timestamp") < origin() - day), series.where((_C("timestamp") >= origin() - day) & (_C("timestamp") < origin())), series.where((_C("timestamp") >= origin()) & (_C("timestamp") < origin() + day))


@query("agg_ridge_fit")
def ridge_fit(spark, d):
    past, _, _ = _pooled_parts(spark, d)
    model = M.fit(past, _TERMS, ["kind", "tariff"])
    terms = spark.createDataFrame(list(model.coefficients.items()), "term string, coefficient double")
    return terms.unionByName(model.zones.select(_C("zone_id").alias("term"), _C("level").alias("coefficient"))).unionByName(model.levels.select(_C("key").alias("term"), _C("level").alias("coefficient")))


@query("job_ridge_recursive")
def ridge_recursive(spark, d):
    """Fitted, corrected by the last day's residuals, and predicted for the next day."""
    past, last, ahead = _pooled_parts(spark, d)
    model = M.fit(past, _TERMS, ["kind", "tariff"], validation=last)
    return M.predict(model, past.unionByName(last), ahead.drop("load_kwh")).select("zone_id", "timestamp", "predicted_kwh")


_GIVEN = {"intercept": 0.5, "lag_1": 0.6, "lag_24": 0.25, "hour_sin": 1.5, "hour_cos": -0.75, "weekday_sin": 0.2, "weekday_cos": 0.1, "energy_price": -1.25, "temperature": 0.05}
_ANGLES = "sin(extract(hour FROM t) * 2 * pi() / 24) * {hour_sin} + cos(extract(hour FROM t) * 2 * pi() / 24) * {hour_cos} + sin((isodow(t) - 1) * 2 * pi() / 7) * {weekday_sin} + cos((isodow(t) - 1) * 2 * pi() / 7) * {weekday_cos}".format(**_GIVEN)
_RECURSIVE = f"""WITH RECURSIVE ahead AS (
    SELECT zone_id, timestamp AS t, row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) - 1 AS k, {_ANGLES.replace(" t)", " timestamp)").replace("(t)", "(timestamp)")} + {_GIVEN["intercept"]} + {_GIVEN["energy_price"]} * (energy_price * 1.1e0) + {_GIVEN["temperature"]} * temperature
        + length(zone_id) / 10e0 + CASE WHEN hour < 7 THEN -0.5e0 WHEN hour < 17 THEN 0.25e0 ELSE 0e0 END + CASE WHEN zone_id LIKE '%-1' THEN 0.1e0 * (((row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) - 1) % 5) - 2) ELSE 0e0 END AS fixed
    FROM zone_series WHERE timestamp >= {_O} AND timestamp < {_O} + INTERVAL 2 DAY),
past AS (SELECT zone_id, list(load_kwh ORDER BY timestamp) AS known FROM zone_series WHERE timestamp >= {_O} - INTERVAL 1 DAY AND timestamp < {_O} GROUP BY zone_id),
steps(zone_id, k, known, p) AS (
    SELECT zone_id, -1, known, 0e0 FROM past
    UNION ALL
    SELECT zone_id, k, list_append(known[2:], p), p FROM (
        SELECT s.zone_id, a.k, s.known, greatest(0, fixed + {_GIVEN["lag_1"]} * s.known[-1] + {_GIVEN["lag_24"]} * s.known[-24]) AS p FROM steps s JOIN ahead a ON a.zone_id = s.zone_id AND a.k = s.k + 1))
SELECT zone_id, t AS timestamp, k AS "offset", p AS predicted_kwh FROM steps JOIN ahead USING (zone_id, k)"""


@query("job_pooled_schedule", _RECURSIVE, X.SERIES, "predicted_kwh")
def pooled_schedule(spark, d):
    """A saved model's recursion over two days under a schedule of prices, with biases of some zones."""
    series = X.zone_series(spark, d).withColumn("tariff", F.when(_C("hour") < 7, "night").when(_C("hour") < 17, "day").otherwise("peak"))
    zones = series.select("zone_id").distinct()
    levels = spark.createDataFrame([("tariff=night", -0.5), ("tariff=day", 0.25)], "key string, level double")
    bias = zones.where("zone_id LIKE '%-1'").withColumn("bias", F.array(*[F.lit(0.1 * (k - 2)) for k in range(5)]))
    model = M.Pooled(_GIVEN, _TERMS, ["tariff"], zones.withColumn("level", F.length("zone_id") / 10), levels, bias)
    ahead = series.where((_C("timestamp") >= origin()) & (_C("timestamp") < origin() + F.expr("interval 2 days")))
    return M.predict(model, series.where(_C("timestamp") < origin()), ahead.drop("load_kwh"), ahead.withColumn("energy_price", _C("energy_price") * 1.1))


@query("job_custom_predictor", "SELECT a.zone_id, a.origin, a.timestamp, h.load_kwh AS predicted_kwh FROM ahead a JOIN hist h ON h.zone_id = a.zone_id AND h.origin = a.origin AND h.timestamp = a.timestamp - INTERVAL 1 DAY", f"{X.SERIES}, {HIST}")
def custom_predictor(spark, d):
    def last_day(context, ahead):
        return ahead[["timestamp"]].assign(predicted_kwh=context["load_kwh"].tail(24).to_numpy()[: len(ahead)])

    pick = ["zone_id", "origin", "timestamp", "load_kwh", "energy_price"]
    return C.custom_predictor(C.at_origins(X.zone_series(spark, d), origins(spark), -DAYS, 0).select(*pick), C.at_origins(X.zone_series(spark, d), origins(spark), 0, 1).select(*pick).drop("load_kwh"), last_day)

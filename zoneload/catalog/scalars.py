"""Queries over column functions."""

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bands, pricing
from ..functions import scalars as S
from ..registry import query

_LOADS = """loads AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE l_quantity * 3 END AS load,
    CAST(l_partkey % 20 - 3 AS DOUBLE) AS low, CASE WHEN l_orderkey % 31 = 0 THEN CAST(l_partkey % 20 - 3 AS DOUBLE) ELSE CAST(l_partkey % 20 - 3 + l_suppkey % 150 AS DOUBLE) END AS high,
    l_discount AS discount, l_tax AS tax, l_extendedprice AS price, l_shipdate AS t FROM lineitem)"""
_POSITION = "CASE WHEN load IS NULL THEN 0 WHEN high <= low THEN 50 ELSE greatest(0, (load - low) / (high - low) * 100) END"
_BAND = "CASE WHEN {0} < 35 THEN 'Low' WHEN {0} < 80 THEN 'Medium' WHEN {0} < 90 THEN 'High' ELSE 'Extremely High' END"
_AT = "(greatest(0, low) + (greatest(0, low, high) - greatest(0, low)) * {0} / 100)"
_TARGET = f"CASE WHEN greatest(0, coalesce(load, 0)) < {_AT.format(35)} THEN {_AT.format(35.5)} WHEN greatest(0, coalesce(load, 0)) >= {_AT.format(80)} THEN {_AT.format(79.5)} ELSE greatest(0, coalesce(load, 0)) END"


def loads(spark, d):
    low = (F.col("l_partkey") % 20 - 3).cast("double")
    return X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.when(F.col("l_orderkey") % 29 != 0, F.col("l_quantity") * 3).alias("load"), low.alias("low"),
        F.when(F.col("l_orderkey") % 31 == 0, low).otherwise((F.col("l_partkey") % 20 - 3 + F.col("l_suppkey") % 150).cast("double")).alias("high"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("t"),
    )


def _cols(*names):
    return [F.col(n) for n in names]


@query("fn_datetime_24h", """SELECT k, text, CASE WHEN k % 5 = 0 THEN date_trunc('day', t) + INTERVAL 1 DAY WHEN k % 5 = 1 THEN NULL ELSE t END AS time FROM (
    SELECT k, t, CASE WHEN k % 5 = 0 THEN strftime(t, '%Y/%m/%d') || ' 24:00' || CASE WHEN k % 2 = 0 THEN ':00+08:00' ELSE '' END WHEN k % 5 = 1 THEN strftime(t, '%Y-%m-%d') || ' 24:01' WHEN k % 5 = 2 THEN strftime(t, '%Y/%m/%d %H:%M:%S') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') END AS text
    FROM (SELECT o_orderkey AS k, o_orderdate AS t FROM orders))""")
def datetime_24h(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    day = lambda f: F.date_format("o_orderdate", f)
    text = F.when(k % 5 == 0, F.concat(day("yyyy/MM/dd"), F.lit(" 24:00"), F.when(k % 2 == 0, ":00+08:00").otherwise(""))).when(k % 5 == 1, F.concat(day("yyyy-MM-dd"), F.lit(" 24:01"))).when(k % 5 == 2, day("yyyy/MM/dd HH:mm:ss")).otherwise(day("yyyy-MM-dd'T'HH:mm:ss"))
    return X.table(spark, d, "orders").select(k.alias("k"), text.alias("text"), S.datetime_24h(text).alias("time"))


@query("fn_time_identity", """SELECT k, label, CASE WHEN k % 3 = 0 THEN strftime(t - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN k % 3 = 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') ELSE label END AS identity FROM (
    SELECT o_orderkey AS k, o_orderdate AS t, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+08:00' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' ELSE 'run-' || o_orderkey END AS label FROM orders)""")
def time_identity(spark, d):
    k, t = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    label = F.when(k % 3 == 0, F.concat(t, F.lit("+08:00"))).when(k % 3 == 1, F.concat(t, F.lit("Z"))).otherwise(F.concat(F.lit("run-"), k.cast("string")))
    return X.table(spark, d, "orders").select(k.alias("k"), label.alias("label")).withColumn("identity", S.time_identity(F.col("label")))


@query("fn_stress_name", """SELECT k, label, CASE lower(trim(replace(label, '_', ' '))) WHEN 'critical' THEN 'Extremely High' WHEN 'moderate' THEN 'Medium' WHEN 'extreme high' THEN 'Extremely High' WHEN 'low' THEN 'Low' WHEN 'high' THEN 'High' END AS band
    FROM (SELECT o_orderkey AS k, ([' LOW ', 'Moderate', 'extreme_high', 'critical', 'hot', 'High', NULL])[o_orderkey % 7 + 1] AS label FROM orders)""")
def stress_name(spark, d):
    labels = F.array(*[F.lit(x) for x in (" LOW ", "Moderate", "extreme_high", "critical", "hot", "High", None)])
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), labels[(F.col("o_orderkey") % 7).cast("int")].alias("label")).withColumn("band", bands.band_name(F.col("label")))


@query("fn_threshold_load", f"SELECT k, line, {_AT.format(35)} AS low_medium_kwh, {_AT.format(80)} AS medium_high_kwh, {_AT.format(90)} AS high_extreme_kwh FROM loads", _LOADS, "low_medium_kwh medium_high_kwh high_extreme_kwh")
def threshold_load(spark, d):
    low, high = _cols("low", "high")
    return loads(spark, d).select("k", "line", bands.threshold(low, high, 35.0).alias("low_medium_kwh"), bands.threshold(low, high, 80.0).alias("medium_high_kwh"), bands.threshold(low, high, 90.0).alias("high_extreme_kwh"))


@query("fn_range_position", f"SELECT k, line, {_POSITION} AS position_pct FROM loads", _LOADS, "position_pct")
def range_position(spark, d):
    return loads(spark, d).select("k", "line", bands.range_position(*_cols("load", "low", "high")).alias("position_pct"))


@query("fn_classify_band", f"SELECT k, line, {_BAND.format('p')} AS band FROM (SELECT k, line, {_POSITION} AS p FROM loads)", _LOADS)
def classify_band(spark, d):
    return loads(spark, d).select("k", "line", bands.classify(bands.range_position(*_cols("load", "low", "high"))).alias("band"))


@query("fn_target_load", f"SELECT k, line, {_TARGET} AS target_kwh FROM loads", _LOADS, "target_kwh")
def target_load(spark, d):
    return loads(spark, d).select("k", "line", bands.target(*_cols("load", "low", "high")).alias("target_kwh"))


@query("fn_cyclic_calendar", "SELECT zone_id, timestamp, sin(hour * 2 * pi() / 24) AS hour_sin, cos(hour * 2 * pi() / 24) AS hour_cos, sin(day_of_week * 2 * pi() / 7) AS weekday_sin, cos(day_of_week * 2 * pi() / 7) AS weekday_cos FROM zone_series", X.SERIES, "hour_sin hour_cos weekday_sin weekday_cos")
def cyclic_calendar(spark, d):
    return X.zone_series(spark, d).withColumns({**S.cyclic(F.col("hour"), 24, "hour"), **S.cyclic(F.col("day_of_week"), 7, "weekday")}).select("zone_id", "timestamp", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos")


@query("fn_blend", "SELECT k, line, alpha / 10e0 AS alpha, greatest(0, (1 - alpha / 10e0) * load + alpha / 10e0 * high) AS blended_kwh FROM loads, range(0, 11) AS a(alpha) WHERE load IS NOT NULL", _LOADS, "blended_kwh")
def blend(spark, d):
    grid = loads(spark, d).where("load IS NOT NULL").withColumn("alpha", F.explode(F.array(*[F.lit(i / 10) for i in range(11)])))
    return grid.select("k", "line", "alpha", S.blend(*_cols("load", "high", "alpha")).alias("blended_kwh"))


@query("fn_intervals", """SELECT k, line, least(load, greatest(0, load - greatest(0, high - low) / 2)) AS q10_kwh, load + greatest(0, high - low) / 2 AS q90_kwh,
    CASE WHEN low <= 0 THEN load ELSE least(load, greatest(0, load - low)) END AS fixed_q10_kwh, load + greatest(0, low) AS fixed_q90_kwh FROM (SELECT * FROM loads WHERE load IS NOT NULL)""", _LOADS, "q10_kwh q90_kwh fixed_q10_kwh fixed_q90_kwh")
def intervals(spark, d):
    rows = loads(spark, d).where("load IS NOT NULL")
    fixed = {f"fixed_{k}": v for k, v in S.symmetric_interval(*_cols("load", "low")).items()}
    return rows.withColumns({**S.rebuilt_interval(*_cols("load", "low", "high")), **fixed}).select("k", "line", "q10_kwh", "q90_kwh", "fixed_q10_kwh", "fixed_q90_kwh")


@query("fn_price_compare", "SELECT k, line, discount - tax AS price_difference, CASE WHEN tax <> 0 THEN (discount - tax) / tax * 100 END AS price_difference_pct FROM loads", _LOADS, "price_difference price_difference_pct")
def price_compare(spark, d):
    return loads(spark, d).withColumns(pricing.compared(*_cols("discount", "tax"))).select("k", "line", "price_difference", "price_difference_pct")


_FINAL = "SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE (discount - 0.5) * 300 END AS shift, CASE WHEN k % 3 = 1 THEN NULL WHEN k % 11 = 0 THEN -1 ELSE discount * 7 END AS proposed FROM loads"


@query("fn_finalize_price", f"""SELECT k, line, coalesce(shift, CASE WHEN tax <> 0 THEN (proposed / tax - 1) * 100 END, 0) AS suggested_price_shift_pct, coalesce(proposed, tax * (1 + shift / 100)) AS proposed_energy_price,
    coalesce(round(coalesce(proposed, tax * (1 + shift / 100)), 10) >= 0, false) AS price_valid FROM ({_FINAL})""", _LOADS, "suggested_price_shift_pct proposed_energy_price")
def finalize_price(spark, d):
    k = F.col("k")
    rows = loads(spark, d).withColumns({"shift": F.when(k % 3 != 0, (F.col("discount") - 0.5) * 300), "proposed": F.when(k % 3 == 1, F.lit(None)).when(k % 11 == 0, -1.0).otherwise(F.col("discount") * 7)})
    found = pricing.finalized(*_cols("tax", "shift", "proposed"))
    price = F.coalesce("proposed", F.col("tax") * (1 + F.col("shift") / 100))
    unrounded = {"suggested_price_shift_pct": F.coalesce("shift", F.when(F.col("tax") != 0, (F.try_divide("proposed", "tax") - 1) * 100), F.lit(0.0)), "proposed_energy_price": price}
    return rows.select("k", "line", *[c.alias(n) for n, c in {**found, **unrounded}.items()])


_ELASTIC = """least(0.7, greatest(0.05, coalesce(CASE WHEN line = 3 THEN abs(discount * 8 - 0.4e0) END, CASE WHEN line = 5 AND tax > 0.03 THEN tax * 9 END, CASE WHEN contains(c, 'residential') THEN 0.45e0 WHEN contains(c, 'commercial') OR contains(c, 'mall') THEN 0.32e0 WHEN contains(c, 'cbd') OR contains(c, 'office') THEN 0.24e0
    WHEN contains(c, 'transport') OR contains(c, 'hub') THEN 0.2e0 WHEN contains(c, 'industrial') THEN 0.18e0 ELSE 0.28e0 END * (1 - 0.25e0 * least(1, greatest(0, coalesce(CASE WHEN load > 1 THEN load / 100 ELSE load END, 0)))) * CASE WHEN CASE WHEN line = 6 THEN k % 3 WHEN tax > 0.04 THEN 1 ELSE 0 END > 0 THEN 0.85e0 ELSE 1e0 END)))"""
_KINDS = ["Residential", "Commercial / Mall", "CBD / Office", "Transport Hub", "Industrial", "Park"]
_ELASTIC_ROWS = f"(SELECT *, {_ELASTIC} AS elasticity FROM (SELECT *, lower(({_KINDS})[k % 6 + 1]) AS c FROM loads))"


def _with_elasticity(spark, d):
    kinds = F.array(*[F.lit(x) for x in _KINDS])
    line, tax = _cols("line", "tax")
    rain = F.when(line == 6, F.lit(None)).when(tax > 0.04, 1.0).otherwise(0.0)
    of_window, of_behaviour = F.when(line == 3, F.col("discount") * 8 - 0.4), F.when((line == 5) & (tax > 0.03), -tax * 9)
    factor = pricing.elasticity(kinds[(F.col("k") % 6).cast("int")], F.col("load"), rain, (F.col("k") % 3).cast("double"), of_window, of_behaviour)
    return loads(spark, d).withColumn("elasticity", factor)


@query("fn_elasticity", f"SELECT k, line, elasticity FROM {_ELASTIC_ROWS}", _LOADS, "elasticity")
def elasticity(spark, d):
    return _with_elasticity(spark, d).select("k", "line", "elasticity")


_SMALL = "least(3, greatest(-3, round(discount * 100 - 5, 2)))"
_EXPECTED = f"greatest(0, load * (1 - elasticity * {_SMALL} / 100))"
_SHIFT = f"""greatest(-100, CASE WHEN load <= 1e-9 OR high <= low OR elasticity <= 0 THEN round(discount * 100 - 5, 2) WHEN {_BAND.format("(" + _POSITION + ")")} = 'Medium' THEN
    CASE WHEN {_EXPECTED} >= {_AT.format(35)} AND {_EXPECTED} < {_AT.format(80)} THEN {_SMALL} ELSE 0 END ELSE (1 - {_TARGET} / load) / elasticity * 100 END)"""


@query("fn_price_shift", f"SELECT k, line, {_SHIFT} AS shift_pct FROM {_ELASTIC_ROWS} WHERE load IS NOT NULL", _LOADS, "shift_pct")
def price_shift(spark, d):
    rows = _with_elasticity(spark, d).where("load IS NOT NULL")
    shift = pricing.shift_to_medium(*_cols("load", "low", "high", "elasticity"), F.col("discount") * 100 - 5)
    return rows.select("k", "line", shift.alias("shift_pct"))


@query("fn_error_columns", """SELECT zone, time, run, line, agent_mode, actual_kwh - predicted_kwh AS error_kwh, abs(actual_kwh - predicted_kwh) AS abs_error_kwh,
    CASE WHEN abs(actual_kwh) > 1e-9 THEN abs(actual_kwh - predicted_kwh) / abs(actual_kwh) * 100 END AS abs_pct_error FROM forecast_samples""", X.SAMPLES, "error_kwh abs_error_kwh abs_pct_error")
def error_columns(spark, d):
    return X.forecast_samples(spark, d).withColumns(S.error_columns(*_cols("actual_kwh", "predicted_kwh"))).select("zone", "time", "run", "line", "agent_mode", "error_kwh", "abs_error_kwh", "abs_pct_error")


@query("fn_cache_usage", """SELECT run, step, CASE WHEN ok THEN u END AS cached_tokens, coalesce(u, 0) AS known_cached_tokens, CAST(ok AS BIGINT) AS cache_reported_call_count, ok AS cache_usage_complete, CASE WHEN ok AND prompt_tokens > 0 THEN u / prompt_tokens END AS cache_hit_ratio
    FROM (SELECT *, u IS NOT NULL AND token_usage_complete AS ok FROM (SELECT *, CASE WHEN prompt_tokens IS NOT NULL AND cached_tokens <= prompt_tokens THEN cached_tokens END AS u FROM agent_calls))""", X.CALLS, "cache_hit_ratio")
def cache_usage(spark, d):
    return X.agent_calls(spark, d).select("run", "step", *[c.alias(n) for n, c in S.cache_usage(*_cols("prompt_tokens", "cached_tokens", "token_usage_complete")).items()])


@query("fn_safe_divide", "SELECT k, line, CASE WHEN low <> 0 THEN coalesce(load / low, 0) ELSE 0 END AS ratio FROM loads", _LOADS, "ratio")
def safe_divide(spark, d):
    return loads(spark, d).select("k", "line", S.safe_divide(*_cols("load", "low")).alias("ratio"))


@query("fn_call_fields", """SELECT run, step, stage, TRY_CAST(nullif(regexp_extract(stage, 'round[_ ](\\d+)', 1), '') AS INTEGER) AS round, regexp_matches(stage, 'repair') AS repair
    FROM (SELECT run, step, agent || CASE WHEN step % 2 = 0 THEN '_round_' || attempt ELSE '' END || CASE WHEN step % 3 = 0 THEN '_repair' ELSE '' END AS stage FROM agent_calls)""", X.CALLS)
def call_fields(spark, d):
    stage = F.concat("agent", F.when(F.col("step") % 2 == 0, F.concat(F.lit("_round_"), F.col("attempt").cast("string"))).otherwise(""), F.when(F.col("step") % 3 == 0, "_repair").otherwise(""))
    number = F.nullif(F.regexp_extract("stage", r"round[_ ](\d+)", 1), F.lit("")).cast("int")
    return X.agent_calls(spark, d).select("run", "step", stage.alias("stage")).withColumns({"round": number, "repair": F.col("stage").rlike("repair")})

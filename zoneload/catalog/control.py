"""Queries over price control."""

from pyspark.sql import functions as F

from .. import fixtures as X
from ..plans import control as K
from ..plans import forecast as C
from ..registry import query
from ..session import checkpoint, dealt, kept
from .forecast import _WINDOWS, DAYS, origins, windows
from .scalars import _BAND, _KINDS

_C = F.col
_CATEGORY_SQL = f"({_KINDS})[length(zone_id) % 6 + 1]"


def category():
    return F.array(*[F.lit(k) for k in _KINDS])[F.length("zone_id") % 6]


_LOW, _HIGH = "greatest(0, low_kwh)", "greatest(0, low_kwh, high_kwh)"
_AT = f"({_LOW} + ({_HIGH} - {_LOW}) * {{0}} / 100)"
_TARGET = f"CASE WHEN {{0}} < {_AT.format(35)} THEN {_AT.format(35.5)} WHEN {{0}} >= {_AT.format(80)} THEN {_AT.format(79.5)} ELSE {{0}} END"
_ELASTIC = f"""least(0.7, greatest(0.05, CASE WHEN contains(c, 'residential') THEN 0.45e0 WHEN contains(c, 'commercial') THEN 0.32e0 WHEN contains(c, 'cbd') THEN 0.24e0 WHEN contains(c, 'transport') THEN 0.2e0 WHEN contains(c, 'industrial') THEN 0.18e0 ELSE 0.28e0 END
    * (1 - 0.25e0 * least(1, greatest(0, coalesce(mean_occupancy, 0)))) * CASE WHEN total_rain > 0 THEN 0.85e0 ELSE 1e0 END))"""


def _proposed(source, load, price="mean_energy_price"):
    """The oracle's proposals for rows with low_kwh, high_kwh, a load and a price."""
    pos = f"CASE WHEN high_kwh <= low_kwh THEN 50 ELSE greatest(0, ({load} - low_kwh) / (high_kwh - low_kwh) * 100) END"
    return f"""SELECT *, round({price} * (1 + shift / 100) + 1e-9, 4) AS proposed, coalesce(round({price} * (1 + shift / 100), 10) >= 0, false) AS valid FROM (SELECT *, round(greatest(-100, CASE WHEN {load} <= 1e-9 OR high_kwh <= low_kwh THEN 0 WHEN {_BAND.format("(" + pos + ")")} = 'Medium' THEN 0 ELSE (1 - {_TARGET.format(load)} / {load}) / elasticity * 100 END) + 1e-9, 2) AS shift
    FROM (SELECT *, {_ELASTIC} AS elasticity FROM (SELECT *, lower({_CATEGORY_SQL}) AS c FROM {source})))"""


def _reforecast(source):
    """The oracle's re-forecast of rows with proposed and valid: load, position and band."""
    return f"""SELECT *, {_BAND.format('rp')} AS rlevel FROM (SELECT *, CASE WHEN high_kwh <= low_kwh THEN 50 ELSE greatest(0, (rload - low_kwh) / (high_kwh - low_kwh) * 100) END AS rp FROM {source} JOIN (SELECT zone_id, origin, "window", sum(greatest(0, base_kwh + greatest(-lim, least(lim, slope * (price - hp))))) AS rload
    FROM (SELECT a.zone_id, a.origin, a."window", base_kwh, CASE WHEN valid THEN proposed ELSE a.energy_price END AS price, slope, hp, greatest(base_kwh * 0.3e0, greatest(ml * 0.05e0, 1e-9)) AS lim FROM (SELECT *, (row_number() OVER (PARTITION BY zone_id, origin ORDER BY timestamp) - 1) // 3 AS "window" FROM ar_base) a
        JOIN (SELECT zone_id, origin, "window", proposed, valid FROM {source}) USING (zone_id, origin, "window") JOIN ar_response USING (zone_id, origin) JOIN ar_hours USING (zone_id, origin, hour)) GROUP BY ALL) USING (zone_id, origin, "window"))"""


_P1 = f"{_WINDOWS}, p1 AS ({_proposed('stress', 'sum_predicted_kwh')})"
_R1 = f"{_P1}, r1 AS (SELECT *, valid AND rlevel = 'Medium' AS ok FROM ({_reforecast('p1')}))"
_DROP = "elasticity, c, shift, proposed, valid, rload, rp, rlevel, ok"


def _next(n):
    """The oracle's next attempt: failed windows are proposed anew from their re-forecast load."""
    return f"""q{n} AS ({_proposed(f"(SELECT zone_id, origin, {chr(34)}window{chr(34)}, low_kwh, high_kwh, mean_energy_price, mean_occupancy, total_rain, rload AS new_load FROM r{n - 1})", 'new_load')}),
p{n} AS (SELECT r.* EXCLUDE ({_DROP}), q.elasticity, q.c, CASE WHEN r.ok THEN r.shift ELSE q.shift END AS shift, CASE WHEN r.ok THEN r.proposed ELSE q.proposed END AS proposed, CASE WHEN r.ok THEN r.valid ELSE q.valid END AS valid FROM r{n - 1} r JOIN q{n} q USING (zone_id, origin, "window")),
r{n} AS (SELECT *, valid AND rlevel = 'Medium' AS ok FROM ({_reforecast(f'p{n}')}))"""


_LOOP = f"{_R1}, {_next(2)}, {_next(3)}, trace AS (" + " UNION ALL ".join(f'SELECT zone_id, origin, "window", {n} AS attempt, mean_energy_price, shift, proposed, valid, rload, rlevel, ok FROM r{n}' for n in (1, 2, 3)) + ")"
_REASON = "CASE WHEN NOT valid THEN 'invalid_non_negative_energy_price_constraint' WHEN rlevel <> 'Medium' THEN 'price_conditioned_load_is_' || rlevel END"


def _inputs(spark, d):
    """Windows, hourly forecasts with their window, and the frozen price response and reference; the series
    and the forecasts, which several of them come from, are kept once."""
    from pyspark.sql import Window

    series = kept(X.zone_series(spark, d))
    history = C.at_origins(series, origins(spark), -DAYS, 0)
    raw = checkpoint(C.ar_forecast(series, origins(spark), DAYS))
    number = F.row_number().over(Window.partitionBy("zone_id", "origin").orderBy("timestamp")) - 1
    hourly = raw.select("zone_id", "origin", F.floor(number / 3).alias("window"), "timestamp", "base_kwh", "energy_price")
    return windows(spark, d, raw=raw, series=series), hourly, C.price_response(history), C.hourly_means(history)


def _first(spark, d):
    return K.proposals(windows(spark, d), category())


@query("job_price_proposals", """SELECT zone_id, origin, "window", elasticity, shift AS suggested_price_shift_pct, proposed AS proposed_energy_price, valid AS price_valid, CASE WHEN shift > 0 THEN 'Raise energy price' WHEN shift < 0 THEN 'Reduce energy price' ELSE 'Hold window energy price' END AS action_label FROM p1""", _P1, "elasticity suggested_price_shift_pct proposed_energy_price")
def price_proposals(spark, d):
    return _first(spark, d).select("zone_id", "origin", "window", "elasticity", "suggested_price_shift_pct", "proposed_energy_price", "price_valid", "action_label")


@query("job_price_reforecast", 'SELECT zone_id, origin, "window", rload AS reforecast_load_kwh, rp AS reforecast_load_range_position_pct, rlevel AS reforecast_load_stress_level FROM r1', _R1, "reforecast_load_kwh reforecast_load_range_position_pct")
def price_reforecast(spark, d):
    found, hourly, response, reference = _inputs(spark, d)
    return K.reforecast(K.proposals(found, category()), hourly, response, reference).select("zone_id", "origin", "window", "reforecast_load_kwh", "reforecast_load_range_position_pct", "reforecast_load_stress_level")


@query("join_window_reforecast", """SELECT zone_id, origin, "window", CASE WHEN "window" % 4 = 3 THEN NULL ELSE rload END AS reforecast_load_kwh, CASE WHEN "window" % 4 = 3 THEN 'missing_price_conditioned_forecast_window' ELSE 'reforecast_with_proposed_energy_price' END AS reforecast_source FROM r1""", _R1, "reforecast_load_kwh")
def window_reforecast(spark, d):
    found, hourly, response, reference = _inputs(spark, d)
    return K.reforecast(K.proposals(found, category()), hourly.where("window % 4 <> 3"), response, reference).select("zone_id", "origin", "window", "reforecast_load_kwh", "reforecast_source")


@query("job_assess_control", f"SELECT zone_id, origin, CASE WHEN bool_and(ok) THEN 'success' ELSE 'fail' END AS control_status, count(*) FILTER (NOT ok) AS failed_window_count, string_agg(DISTINCT {_REASON}, ',' ORDER BY {_REASON}) AS reasons FROM r1 GROUP BY zone_id, origin", _R1)
def assess_control(spark, d):
    found, hourly, response, reference = _inputs(spark, d)
    rows = K.assessed(K.reforecast(K.proposals(found, category()), hourly, response, reference))
    reasons = rows.groupBy("zone_id", "origin").agg(F.nullif(F.array_join(F.sort_array(F.collect_set("control_failure_reason")), ","), F.lit("")).alias("reasons"))
    return K.zone_status(rows, ["zone_id", "origin"]).join(reasons, ["zone_id", "origin"])


@query("job_control_loop", f'SELECT zone_id, origin, "window", attempt, shift AS suggested_price_shift_pct, proposed AS proposed_energy_price, rload AS reforecast_load_kwh, rlevel AS reforecast_load_stress_level, ok AS control_success, count(*) FILTER (NOT ok) OVER w AS earlier_failures, coalesce(array_to_string(list(rlevel) FILTER (NOT ok) OVER w, \',\'), \'\') AS earlier_levels FROM trace WINDOW w AS (PARTITION BY zone_id, origin, "window" ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', _LOOP, "suggested_price_shift_pct proposed_energy_price reforecast_load_kwh")
def control_loop(spark, d):
    """The trace, with the failures that each proposal was made from."""
    context = F.transform("retry_context", lambda c: c["reforecast_load_stress_level"])
    shown = [F.size("retry_context").alias("earlier_failures"), F.array_join(context, ",").alias("earlier_levels")]
    return K.control_loop(*_inputs(spark, d), category()).select("zone_id", "origin", "window", "attempt", "suggested_price_shift_pct", "proposed_energy_price", "reforecast_load_kwh", "reforecast_load_stress_level", "control_success", *shown)


@query("win_previous_attempt", """SELECT zone_id, origin, "window", attempt, previous AS previous_energy_price, proposed - previous AS price_change_amount, CASE WHEN previous > 0 THEN (proposed - previous) / previous * 100 END AS price_change_pct, shift - previous_shift AS shift_change_pct, abs(proposed - previous) > 1e-9 AS price_changed, trigger AS trigger_reason
    FROM (SELECT *, CASE WHEN attempt = 1 THEN mean_energy_price ELSE lag(proposed) OVER w END AS previous, CASE WHEN attempt = 1 THEN 0 ELSE lag(shift) OVER w END AS previous_shift, lag(""" + _REASON + """) OVER w AS trigger FROM trace WINDOW w AS (PARTITION BY zone_id, origin, "window" ORDER BY attempt))""", _LOOP, "previous_energy_price price_change_amount price_change_pct shift_change_pct")
def previous_attempt(spark, d):
    trace = K.control_loop(*_inputs(spark, d), category())
    return K.attempt_changes(trace).select("zone_id", "origin", "window", "attempt", "previous_energy_price", "price_change_amount", "price_change_pct", "shift_change_pct", "price_changed", "trigger_reason")


@query("join_merge_revision", """SELECT zone_id, origin, "window", CASE WHEN ok THEN proposed ELSE proposed * 2 END AS proposed_energy_price, CASE WHEN ok THEN 'frozen' ELSE 'revised' END AS proposal_status FROM r1""", _R1, "proposed_energy_price")
def merge_revision(spark, d):
    found, hourly, response, reference = _inputs(spark, d)
    first = K.proposals(found, category())
    before = K.assessed(K.reforecast(first, hourly, response, reference))
    revised = before.withColumn("proposed_energy_price", _C("proposed_energy_price") * 2)
    return K.merged_revision(before, revised).select("zone_id", "origin", "window", "proposed_energy_price", "proposal_status")


@query("job_zone_brief", """SELECT *, CASE worst WHEN 'Extremely High' THEN 15 WHEN 'High' THEN 8 WHEN 'Low' THEN -8 ELSE 0 END AS base_shift_pct, CASE WHEN worst = 'Extremely High' AND c = 'Residential' THEN 'Raise energy price for peak deflection' WHEN worst = 'Extremely High' THEN 'Raise energy price for congestion' WHEN worst = 'High' THEN 'Raise energy price for high load' WHEN worst = 'Low' THEN 'Reduce energy price for utilization' ELSE 'Hold energy price' END AS base_label,
    array_to_string(list_filter([CASE WHEN high_windows > 0 THEN high_windows || ' high-stress 3-hour windows' END, 'peak window ' || strftime(peak_start, '%Y-%m-%d %H:%M'), CASE WHEN rain > 0 THEN 'rain' END], lambda x: x IS NOT NULL), '; ') AS drivers
    FROM (SELECT zone_id, origin, """ + _CATEGORY_SQL + """ AS c, bool_or(load_stress_level <> 'Medium') AS adjustment_needed, count(*) FILTER (load_stress_level IN ('High', 'Extremely High')) AS high_windows, arg_max(window_start, (sum_predicted_kwh, -"window")) AS peak_start, sum(total_rain) AS rain,
        (['Low', 'Medium', 'High', 'Extremely High'])[max(list_position(['Low', 'Medium', 'High', 'Extremely High'], load_stress_level))] AS worst FROM stress GROUP BY ALL)""", _WINDOWS)
def zone_brief(spark, d):
    return K.zone_briefs(windows(spark, d), category()).withColumn("c", category())


_KEYED = """first AS (SELECT l_orderkey AS k, l_linenumber AS position, CAST(min(l_shipdate) AS VARCHAR) AS window_start FROM lineitem GROUP BY ALL),
firstp AS (SELECT k, position, CASE WHEN k % 11 = 4 THEN 'other' ELSE window_start END AS window_start, CASE WHEN k % 7 = 3 THEN NULL ELSE position * 1e0 END AS shift, CASE WHEN k % 5 = 2 THEN NULL ELSE k * 1e0 END AS price, 'label-' || position AS label FROM first WHERE (k + position) % 6 <> 0)"""


def _keyed(spark, d):
    """Expected and proposed windows, both dealt to partitions of a bounded number of rows, so that they are grouped and
    joined where they are."""
    k, p = _C("k"), _C("position")
    items = X.table(spark, d, "lineitem")
    items = dealt(items.select(_C("l_orderkey").alias("k"), _C("l_linenumber").alias("position"), "l_shipdate"), items.count(), ["k", "position"], 200_000)
    rows = items.groupBy("k", "position").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("window_start"))
    proposed = rows.where((k + p) % 6 != 0).select("k", "position", F.when(k % 11 == 4, "other").otherwise(_C("window_start")).alias("window_start"), F.when(k % 7 != 3, p.cast("double")).alias("shift"), F.when(k % 5 != 2, k.cast("double")).alias("price"), F.concat(F.lit("label-"), p.cast("string")).alias("label"))
    return rows, proposed


@query("fn_validate_proposals", """SELECT k, array_to_string(flatten(list(errors ORDER BY position)), '; ') AS errors FROM (SELECT e.k, e.position, list_filter([CASE WHEN p.k IS NULL THEN 'windows[' || e.position || '] missing' END, CASE WHEN p.k IS NOT NULL AND shift IS NULL THEN 'windows[' || e.position || '] invalid shift' END, CASE WHEN p.k IS NOT NULL AND price IS NULL THEN 'windows[' || e.position || '] invalid price' END,
    CASE WHEN p.window_start <> e.window_start THEN 'windows[' || e.position || '] window_start does not match' END], lambda x: x IS NOT NULL) AS errors FROM first e LEFT JOIN firstp p ON p.k = e.k AND p.position = e.position) GROUP BY k""", _KEYED)
def validate_proposals(spark, d):
    expected, proposed = _keyed(spark, d)
    return K.proposal_errors(expected, proposed, ["k"]).select("k", F.array_join("errors", "; ").alias("errors"))


@query("fn_normalize_windows", "SELECT e.k, e.position, e.window_start, shift, price, coalesce(label, 'MODEL_RESPONSE_FAILED') AS label FROM first e LEFT JOIN firstp p ON p.k = e.k AND p.position = e.position", _KEYED)
def normalize_windows(spark, d):
    return K.normalized_windows(*_keyed(spark, d), ["k"])


_CACHE = """cached AS (SELECT zone_id, timestamp AS window_start, CASE WHEN hour % 11 = 5 AND zone_id LIKE '%-1' THEN NULL ELSE load_kwh END AS sum_predicted_kwh, energy_price * 1.2e0 AS energy_price FROM zone_series WHERE hour % 3 = 0 AND NOT (zone_id LIKE '%-2' AND hour = 9)),
expected AS (SELECT zone_id, timestamp AS window_start, load_kwh AS sum_predicted_kwh, energy_price AS base_price, energy_price FROM zone_series WHERE hour % 3 = 0)"""


def _cache(spark, d):
    rows = X.zone_series(spark, d).where("hour % 3 = 0")
    cached = rows.where("NOT (zone_id LIKE '%-2' AND hour = 9)").select("zone_id", _C("timestamp").alias("window_start"), F.when(~((_C("hour") % 11 == 5) & _C("zone_id").like("%-1")), _C("load_kwh")).alias("sum_predicted_kwh"), (_C("energy_price") * 1.2).alias("energy_price"))
    return rows.select("zone_id", _C("timestamp").alias("window_start"), _C("load_kwh").alias("sum_predicted_kwh"), _C("energy_price").alias("base_price"), "energy_price"), cached


@query("join_precomputed_complete", "SELECT e.zone_id, count(*) AS expected, count(c.zone_id) AS usable, count(*) = count(c.zone_id) AS complete FROM expected e LEFT JOIN (SELECT * FROM cached WHERE sum_predicted_kwh IS NOT NULL AND energy_price > 0) c USING (zone_id, window_start) GROUP BY e.zone_id", f"{X.SERIES}, {_CACHE}")
def precomputed_complete(spark, d):
    return K.complete_cached(*_cache(spark, d))


@query("join_precomputed_apply", "SELECT e.zone_id, window_start, base_price, coalesce(c.sum_predicted_kwh, e.sum_predicted_kwh) AS sum_predicted_kwh, coalesce(c.energy_price, e.energy_price) AS energy_price, (coalesce(c.energy_price, e.energy_price) / base_price - 1) * 100 AS shift_pct FROM expected e LEFT JOIN cached c USING (zone_id, window_start)", f"{X.SERIES}, {_CACHE}", "energy_price shift_pct")
def precomputed_apply(spark, d):
    return K.applied_cache(*_cache(spark, d), ["sum_predicted_kwh", "energy_price"])


@query("src_precomputed_windows", "SELECT zone_id, window_start, sum_predicted_kwh, energy_price FROM cached", f"{X.SERIES}, {_CACHE}", "energy_price")
def precomputed_windows(spark, d):
    from ..functions.scalars import datetime_24h

    _, cached = _cache(spark, d)
    at = _C("window_start") - F.expr("interval 1 day")
    text = F.when(F.hour("window_start") == 0, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" 24:00"))).otherwise(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return cached.withColumn("window_start", datetime_24h(text))


@query("prj_allowlist", 'SELECT zone_id, origin, list({\'window\': "window", \'sum_predicted_kwh\': round(sum_predicted_kwh, 3), \'load_stress_level\': load_stress_level} ORDER BY "window")[1].load_stress_level AS first_level, count(*) AS windows, false AS leaks FROM stress GROUP BY zone_id, origin', _WINDOWS)
def allowlist(spark, d):
    """Decision context keeps allowed fields only: no actual load reaches it."""
    allowed = ["window", "sum_predicted_kwh", "load_stress_level"]
    nested = windows(spark, d).groupBy("zone_id", "origin").agg(F.sort_array(F.collect_list(F.struct("window", "sum_predicted_kwh", "load_stress_level", "sum_actual_kwh", "actual_load_stress_level"))).alias("w"))
    safe = nested.withColumn("w", F.transform("w", lambda x: F.struct(*[x[a].alias(a) for a in allowed])))
    return safe.select("zone_id", "origin", _C("w")[0]["load_stress_level"].alias("first_level"), F.size("w").cast("long").alias("windows"), F.to_json("w").contains("actual").alias("leaks"))

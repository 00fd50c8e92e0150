"""Queries over the evaluation of saved runs."""

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import canonical as CF
from ..functions import provenance as PV
from ..operators import evaluation as E
from ..operators import outcomes as O
from ..operators import pairing as PE
from ..registry import query
from ..session import checkpoint, dealt, shared_folder
from ..sources import results as RS
from .features import summary

_C = F.col
_FINE = "actual_kwh IS NOT NULL AND predicted_kwh IS NOT NULL"


_KNOWN = "origin IS NOT NULL AND training_end IS NOT NULL"


def _errors_sql(source, keys, extra=True):
    k = ", ".join(keys)
    more = f""", avg(CASE WHEN actual_kwh IS NOT NULL AND q10_kwh IS NOT NULL THEN CAST(actual_kwh BETWEEN q10_kwh AND q90_kwh AS DOUBLE) END) * 100 AS interval_coverage_pct, count(*) FILTER (training_overlap) AS training_overlap_count, count(training_overlap) AS training_known_count, count(*) FILTER (training_overlap IS NULL) AS training_unknown_count,
        CASE WHEN bool_or(coalesce(training_overlap, false) OR ({_KNOWN} AND origin < training_end)) THEN false WHEN bool_and({_KNOWN}) THEN true END AS out_of_sample"""
    return f"""SELECT {k}, count(*) AS n_total, count(*) FILTER ({_FINE}) AS n, count(*) FILTER ({_FINE} AND abs(actual_kwh) > 1e-9) AS n_mape, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, CASE WHEN sum(abs(actual_kwh - m)) FILTER ({_FINE}) > 1e-9 THEN sum(e) / sum(abs(actual_kwh - m)) FILTER ({_FINE}) END AS rae,
        avg(e / nullif(abs(actual_kwh), 0)) * 100 AS mape_pct, CASE WHEN sum(abs(actual_kwh)) FILTER ({_FINE}) > 1e-9 THEN sum(e) / sum(abs(actual_kwh)) FILTER ({_FINE}) * 100 END AS wape_pct,
        sum(actual_kwh) FILTER ({_FINE}) AS actual_total_kwh, sum(predicted_kwh) FILTER ({_FINE}) AS predicted_total_kwh, (sum(predicted_kwh) FILTER ({_FINE}) - sum(actual_kwh) FILTER ({_FINE})) / nullif(sum(actual_kwh) FILTER ({_FINE}), 0) * 100 AS bias_pct{more if extra else ""}
        FROM (SELECT *, abs(actual_kwh - predicted_kwh) AS e, avg(actual_kwh) FILTER ({_FINE}) OVER (PARTITION BY {k}) AS m FROM {source}) GROUP BY {k}"""


_ERRORS = "mae rmse rae mape_pct wape_pct actual_total_kwh predicted_total_kwh bias_pct interval_coverage_pct"
_KEYS = ["zone", "time", "run", "line", "model", "batch", "actual_kwh", "predicted_kwh"]
_DEDUP = f"(SELECT {', '.join(_KEYS)}, any_value(q10_kwh) AS q10_kwh, any_value(q90_kwh) AS q90_kwh, any_value(origin) AS origin, any_value(training_overlap) AS training_overlap, any_value(training_end) AS training_end, count(*) - 1 AS copies FROM forecast_samples GROUP BY {', '.join(_KEYS)})"
_LEVELS = {"batch": ["batch"], "model": ["model"], "zone_model": ["zone", "model"], "origin": ["batch", "origin"], "zone_origin": ["batch", "zone", "origin"]}


@query("agg_zone_metrics", _errors_sql("(SELECT * FROM forecast_samples WHERE actual_kwh IS NOT NULL)", ["zone"]), X.SAMPLES, _ERRORS)
def zone_metrics(spark, d):
    return E.pooled_errors(X.forecast_samples(spark, d).where("actual_kwh IS NOT NULL"), ["zone"])


@query("agg_pooled_metrics", _errors_sql("forecast_samples", ["batch", "model"]), X.SAMPLES, _ERRORS)
def pooled_metrics(spark, d):
    return E.pooled_errors(X.forecast_samples(spark, d), ["batch", "model"])


def _level_sql(level, columns):
    key = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"SELECT '{level}' AS level, {key} AS key, * EXCLUDE ({', '.join(columns)}) FROM ({_errors_sql('dedup', columns)}) JOIN (SELECT {', '.join(columns)}, CAST(sum(copies) AS BIGINT) AS copies_removed FROM dedup GROUP BY ALL) USING ({', '.join(columns)})"


@query("agg_forecast_tables", " UNION ALL ".join(f"({_level_sql(n, c)})" for n, c in _LEVELS.items()), f"{X.SAMPLES}, dedup AS {_DEDUP}", _ERRORS)
def forecast_tables(spark, d):
    """All levels in one pass over the rows without copies."""
    rows = E.deduplicated(X.forecast_samples(spark, d).drop("agent_mode"), _KEYS)
    return E.pooled_errors(E.at_levels(rows, _LEVELS), ["level", "key"])


@query("set_dedup_forecasts", f"SELECT (SELECT count(*) FROM {_DEDUP}) AS kept, (SELECT count(*) FROM forecast_samples) - (SELECT count(*) FROM {_DEDUP}) AS removed", X.SAMPLES)
def dedup_forecasts(spark, d):
    return E.deduplicated(X.forecast_samples(spark, d).drop("agent_mode"), _KEYS).agg(F.count("*").alias("kept"), F.sum("copies").alias("removed"))


@query("set_conflicts", """SELECT * FROM (SELECT zone, model, time, count(DISTINCT actual_kwh) + max(CAST(actual_kwh IS NULL AS BIGINT)) AS n_actual_kwh, count(DISTINCT predicted_kwh) + max(CAST(predicted_kwh IS NULL AS BIGINT)) AS n_predicted_kwh FROM forecast_samples GROUP BY ALL) WHERE n_actual_kwh > 1 OR n_predicted_kwh > 1""", X.SAMPLES)
def set_conflicts(spark, d):
    return E.conflicts(X.forecast_samples(spark, d), ["zone", "model", "time"], ["actual_kwh", "predicted_kwh"])


@query("set_union_runs", "SELECT 'multi' AS mode, zone, run, NULL AS only_single, predicted_kwh FROM base_samples WHERE line % 2 = 1 UNION ALL SELECT 'single', zone, NULL, line, predicted_kwh FROM base_samples WHERE line % 2 = 0", X.SAMPLES)
def union_runs(spark, d):
    rows = X.forecast_samples(spark, d).where("agent_mode = 'multi'")
    a = rows.where("line % 2 = 1").select(F.lit("multi").alias("mode"), "zone", "run", "predicted_kwh")
    b = rows.where("line % 2 = 0").select(F.lit("single").alias("mode"), "zone", _C("line").alias("only_single"), "predicted_kwh")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_expected_windows", """SELECT run, zone, "window", status FROM (SELECT coalesce(o.run, e.run) AS run, coalesce(o.zone, e.zone) AS zone, coalesce(o."window", e."window") AS "window", CASE WHEN o.n IS NULL THEN 'missing' WHEN e.run IS NULL THEN 'extra' WHEN o.n > 1 THEN 'duplicate' END AS status
    FROM (SELECT run, zone, "window", count(*) AS n FROM window_rounds WHERE round = 1 OR (round = 2 AND run = 3) GROUP BY ALL) o FULL JOIN (SELECT * FROM (SELECT DISTINCT run FROM window_rounds), (SELECT unnest(range(5)) AS zone), (SELECT unnest(range(7)) AS "window")) e ON o.run = e.run AND o.zone = e.zone AND o."window" = e."window") WHERE status IS NOT NULL""", X.ROUNDS)
def set_expected(spark, d):
    rows = X.window_rounds(spark, d)
    grid = rows.select("run").distinct().withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    grid = grid.select("run", "zone", "window")
    return E.expected_windows(rows.where("round = 1 OR (round = 2 AND run = 3)"), grid, ["run", "zone", "window"])


_HISTORY = """SELECT *, CASE WHEN known THEN ft END AS first_entry_round, CASE WHEN ft IS NOT NULL THEN true WHEN fn IS NULL THEN false END AS ever_medium, CASE WHEN baseline_medium THEN false WHEN NOT baseline_medium THEN CASE WHEN ft IS NOT NULL THEN true WHEN fn IS NULL THEN false END END AS ever_newly_medium
    FROM (SELECT *, CASE WHEN baseline_medium IS NULL THEN false WHEN baseline_medium THEN true ELSE coalesce(fn IS NULL OR ft < fn, false) END AS known
    FROM (SELECT *, lag(medium) OVER w AS previous_medium, min(CASE WHEN medium THEN round END) OVER w AS ft, min(CASE WHEN medium IS NULL THEN round END) OVER w AS fn, first_value(medium) OVER w AS baseline_medium FROM {} WINDOW w AS (PARTITION BY run, zone, "window" ORDER BY round)))"""
_GRID = f"""grid AS (SELECT run, zone, "window", round, CASE WHEN carried THEN fl ELSE load_kwh END AS load_kwh, CASE WHEN carried THEN fs ELSE stress END AS stress, CASE WHEN carried THEN fs ELSE stress END = 'Medium' AS medium, CASE WHEN carried THEN 'early_stop_carry' WHEN load_kwh IS NULL THEN 'missing' WHEN round = 0 THEN 'baseline' ELSE 'attempt_trace' END AS source
    FROM (SELECT f.run, f.zone, f."window", r.round, w.load_kwh, w.stress, f.load_kwh AS fl, f.stress AS fs, w.run IS NULL AND f.status = 'success' AND f.attempts_used < f.attempt_limit AND r.round > f.attempts_used AS carried
    FROM run_finals f CROSS JOIN (SELECT unnest(range(4)) AS round) r LEFT JOIN window_rounds w ON w.run = f.run AND w.zone = f.zone AND w."window" = f."window" AND w.round = r.round)),
entries AS ({_HISTORY.format("grid")}),
ending AS (SELECT g.run, g.zone, g."window", g.round, CASE WHEN g.round = attempts_used AND attempts_used > 0 THEN f.stress = 'Medium' ELSE medium END AS medium, f.load_kwh, f.stress, f.stress = 'Medium' AS final_medium, attempts_used
    FROM grid g JOIN run_finals f USING (run, zone, "window") WHERE g.round <= attempts_used),
finals AS (SELECT run, zone, "window", round, load_kwh, stress, final_medium AS medium, 'final_windows' AS source, previous_medium, baseline_medium, first_entry_round, known, ever_medium, ever_newly_medium FROM ({_HISTORY.format("ending")}) WHERE round = attempts_used)"""
_WK = ["run", "zone", "window"]


def grid(spark, d):
    """Window rounds with gaps as unknown and final windows carried on after an early stop; and the final windows."""
    rows = X.window_rounds(spark, d)
    finals = X.run_finals(rows)
    return E.round_grid(rows.select(*_WK, "round", "load_kwh", "stress"), _WK, 3, finals), finals


def history(spark, d):
    """Rounds and final windows with history fields, in one pass."""
    rows = X.window_rounds(spark, d)
    return E.outcome_history(rows.select(*_WK, "round", "load_kwh", "stress"), _WK, 3, X.run_finals(rows))


def rounds(spark, d):
    """The grid with history fields and the baseline's state."""
    return with_baseline(E.history_fields(grid(spark, d)[0], _WK))


def with_baseline(rows):
    from pyspark.sql import Window

    return rows.withColumn("baseline_medium", F.first("medium").over(Window.partitionBy(*_WK).orderBy("round")))


@query("win_round_rows", """SELECT run, zone, "window", CASE WHEN round = 0 THEN 'baseline' ELSE 'round' END AS phase, round, load_kwh, stress, medium, source FROM grid
    UNION ALL SELECT run, zone, "window", 'final', round, load_kwh, stress, medium, source FROM finals""", f"{X.ROUNDS}, {_GRID}")
def round_rows(spark, d):
    rows, finals = grid(spark, d)
    shown = [*_WK, "phase", "round", "load_kwh", "stress", "medium", "source"]
    phase = F.when(_C("round") == 0, "baseline").otherwise("round")
    return rows.withColumn("phase", phase).select(*shown).unionByName(E.final_rows(rows, _WK, finals).withColumn("phase", F.lit("final")).select(*shown))


_ENTRY = "previous_medium, first_entry_round, known AS first_entry_known, ever_medium, ever_newly_medium"


@query("win_first_entry", f"""SELECT run, zone, "window", CASE WHEN round = 0 THEN 'baseline' ELSE 'round' END AS phase, round, {_ENTRY} FROM entries UNION ALL SELECT run, zone, "window", 'final', round, {_ENTRY} FROM finals""", f"{X.ROUNDS}, {_GRID}")
def first_entry(spark, d):
    return history(spark, d).select(*_WK, "phase", "round", "previous_medium", "first_entry_round", "first_entry_known", "ever_medium", "ever_newly_medium")


_ALL = "CASE WHEN bool_or(NOT {0}) THEN false WHEN count(*) > count({0}) THEN NULL ELSE true END"
_ANY = "CASE WHEN bool_or({0}) THEN true WHEN count(*) > count({0}) THEN NULL ELSE false END"


#: Dimensions of a run, beside its zone: each outcome row has them.
_DIMS = {"batch": "run % 2", "dataset": "'set-' || run % 3", "backend": "CASE WHEN run % 4 < 2 THEN 'ar' ELSE 'ridge' END", "agent_mode": "CASE WHEN run % 5 < 3 THEN 'multi' ELSE 'single' END", "forecast_origin": "run % 7"}
#: The tables' sets of dimensions.
OUTCOME_SETS = {
    "round_overall": ["batch"], "round_by_dataset": ["batch", "dataset"], "round_by_dataset_model": ["batch", "dataset", "backend"], "round_by_mode": ["batch", "agent_mode"],
    "round_by_origin_model_mode": ["batch", "dataset", "forecast_origin", "backend", "agent_mode"], "round_by_zone": ["batch", "dataset", "backend", "agent_mode", "forecast_origin", "zone"],
}
_SHOWN_ROWS = 'run, zone, "window", phase, round, medium, baseline_medium, previous_medium, first_entry_round, known, ever_medium, ever_newly_medium, stress'
_OUTCOMES = f"""outcomes AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _DIMS.items())}, CASE WHEN phase <> 'baseline' AND run % 6 <> 1 THEN medium END AS control_success FROM (
    SELECT {_SHOWN_ROWS} FROM (SELECT *, CASE WHEN round = 0 THEN 'baseline' ELSE 'round' END AS phase FROM entries)
    UNION ALL SELECT {_SHOWN_ROWS} FROM (SELECT *, 'final' AS phase FROM finals)) JOIN (SELECT run, zone, count(*) AS zone_expected FROM run_finals GROUP BY run, zone) USING (run, zone) JOIN (SELECT run, 30 AS run_expected FROM run_finals GROUP BY run) USING (run))"""
_TESTS = dict(zip(O.COUNTS, (
    "true", "medium IS NOT NULL", "medium", "baseline_medium", "baseline_medium IS NOT NULL", "baseline_medium IS NOT NULL AND medium IS NOT NULL", "NOT baseline_medium AND medium", "baseline_medium AND NOT medium", "previous_medium IS NOT NULL AND medium IS NOT NULL", "NOT previous_medium AND medium", "previous_medium AND NOT medium",
    "NOT baseline_medium AND known AND first_entry_round = round", "NOT known", "NOT baseline_medium AND known AND first_entry_round IS NULL", "ever_newly_medium", "ever_newly_medium IS NULL", "phase = 'final' AND ever_medium AND NOT medium", "phase = 'final' AND ever_newly_medium AND NOT medium", "control_success", "control_success IS NOT NULL"), strict=True))


def _outcome_sql(level, keys, every):
    """One set's table in SQL, its zones and runs counted from the rows themselves."""
    by = ", ".join([*keys, "phase", "round"])
    shown = ", ".join(f"{k if k in keys else 'NULL'} AS {k}" for k in every)
    counts = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in _TESTS.items())
    whole = {z: f"SELECT {by}, count(*) AS {z}_count, count(*) FILTER (whole) AS {z}_complete_count, count(*) FILTER (NOT whole) AS {z}_unknown_count, count(*) FILTER (whole AND good) AS {z}_all_medium_count FROM (SELECT {by}, count(DISTINCT {ids}) >= max({z}_expected) AND count(medium) = count(*) AS whole, bool_and(coalesce(medium, false)) AS good FROM outcomes GROUP BY {', '.join(dict.fromkeys([*keys, 'phase', 'round', 'run', *(['zone'] if z == 'zone' else [])]))}) GROUP BY {by}" for z, ids in (("zone", '"window"'), ("run", "zone || '/' || \"window\""))}
    return f"""SELECT '{level}' AS level, {shown}, phase, round, t.* EXCLUDE ({by}), z.* EXCLUDE ({by}), r.* EXCLUDE ({by}), window_count - medium_known_count AS medium_unknown_count, medium_known_count * 100e0 / window_count AS medium_coverage_pct, medium_count * 100e0 / nullif(medium_known_count, 0) AS medium_rate_pct,
        window_count - baseline_medium_known_count AS baseline_medium_unknown_count, window_count - baseline_comparable_count AS baseline_unknown_transition_count, new_medium_count - lost_medium_count AS net_medium_count, window_count - adjacent_comparable_count AS adjacent_unknown_transition_count, gained_medium_count - exited_medium_count AS adjacent_net_medium_count, window_count - control_success_known_count AS control_success_unknown_count
        FROM (SELECT {by}, {counts}, {_spread("CAST(first_entry_round AS VARCHAR)", "NOT baseline_medium AND known AND first_entry_round IS NOT NULL")} AS first_entry_round_distribution, {_spread("coalesce(stress, 'Unknown')", "true")} AS stress_distribution FROM outcomes GROUP BY {by}) t JOIN ({whole['zone']}) z USING ({by}) JOIN ({whole['run']}) r USING ({by})"""


def _spread(label, where):
    counts = f"histogram({label}) FILTER ({where})"
    return f"coalesce(array_to_string(list_sort(list_transform(map_entries({counts}), lambda e: e.key || ':' || e.value)), ','), '')"


def outcome_rows(spark, d):
    """Rounds and final windows of all runs with history fields, dimensions and expected windows."""
    from pyspark.sql import Window

    # The order of the rows as they come, so that they aren't sorted again.
    zone = Window.partitionBy("run", "zone").orderBy("window").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = history(spark, d).where("run IS NOT NULL AND zone IS NOT NULL").withColumn("zone_expected_window_count", F.count_if(_C("phase") == "final").over(zone))
    run = _C("run")
    dims = {"batch": run % 2, "dataset": F.concat(F.lit("set-"), (run % 3).cast("string")), "backend": F.when(run % 4 < 2, "ar").otherwise("ridge"), "agent_mode": F.when(run % 5 < 3, "multi").otherwise("single"), "forecast_origin": run % 7}
    return every.withColumns({"run_expected_window_count": F.lit(30), **dims, "control_success": F.when((_C("phase") != "baseline") & (run % 6 != 1), _C("medium"))})


def outcome_tables(spark, d, sets):
    """The library's tables, with maps as text."""
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    got = O.window_outcomes(outcome_rows(spark, d), sets, 3)
    return got.withColumns({c: text(c) for c in ("first_entry_round_distribution", "stress_distribution")})


_OUTCOME_VIEWS = f"{X.ROUNDS}, {_GRID}, {_OUTCOMES}"
_RUN_SETS = {"run": ["run"]}
_EVERY = list(dict.fromkeys(k for s in OUTCOME_SETS.values() for k in s))


@query("agg_window_summary", _outcome_sql("run", ["run"], ["run"]), _OUTCOME_VIEWS, "medium_coverage_pct medium_rate_pct")
def window_summary(spark, d):
    return outcome_tables(spark, d, _RUN_SETS)


@query("agg_window_tables", " UNION ALL ".join(_outcome_sql(n, s, _EVERY) for n, s in OUTCOME_SETS.items()), _OUTCOME_VIEWS, "medium_coverage_pct medium_rate_pct")
def window_tables(spark, d):
    """All measures for all six sets, in one plan."""
    return outcome_tables(spark, d, OUTCOME_SETS)


@query("top_sorted_tables", """SELECT run, phase, round, windows, row_number() OVER (PARTITION BY run ORDER BY CASE phase WHEN 'baseline' THEN 0 WHEN 'round' THEN 1 ELSE 2 END, round) AS position FROM (SELECT run, CASE WHEN round = 0 THEN 'baseline' ELSE 'round' END AS phase, round, count(*) AS windows FROM grid GROUP BY ALL UNION ALL SELECT run, 'final', round, count(*) FROM finals GROUP BY ALL)""", f"{X.ROUNDS}, {_GRID}")
def sorted_tables(spark, d):
    from pyspark.sql import Window

    every, finals = grid(spark, d)
    phase = F.when(_C("round") == 0, "baseline").otherwise("round")
    rows = every.select("run", phase.alias("phase"), "round").unionByName(E.final_rows(every, _WK, finals).select("run", F.lit("final").alias("phase"), "round"))
    rows = rows.groupBy("run", "phase", "round").agg(F.count("*").alias("windows"))
    order = F.when(_C("phase") == "baseline", 0).when(_C("phase") == "round", 1).otherwise(2)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("run").orderBy(order, "round")).cast("long")).orderBy("run", "position")


_BM = "run % 2 AS batch, CASE WHEN run % 5 < 3 THEN 'multi' ELSE 'single' END AS agent_mode"
_MATRIX = ", ".join(f'count(*) FILTER (round = {n} AND medium) AS "{n}_medium", count(*) FILTER (round = {n} AND NOT baseline_medium AND medium) AS "{n}_new", count(*) FILTER (round = {n} AND medium IS NULL) AS "{n}_unknown", count(*) FILTER (round = {n} AND known AND first_entry_round = {n}) AS "{n}_entered"' for n in range(4))
_SPENT = ", ".join(f'CASE WHEN count(*) FILTER (round = {n} AND tokens IS NULL) = 0 AND count(DISTINCT run) FILTER (round = {n}) = count(DISTINCT run) THEN sum(tokens) FILTER (round = {n}) / count(DISTINCT run) END AS mean_tokens_{n}' for n in range(1, 4))


@query("agg_round_matrix", f"""SELECT * FROM (SELECT batch, agent_mode, count(DISTINCT run) AS run_count, {_MATRIX} FROM (SELECT *, {_BM} FROM entries) GROUP BY ALL)
    JOIN (SELECT batch, agent_mode, {_SPENT} FROM (SELECT *, CASE WHEN NOT (round = 3 AND run % 10 = 4) THEN run * 10 + round END AS tokens, {_BM} FROM (SELECT DISTINCT run FROM grid), (SELECT unnest(range(1, 4)) AS round)) GROUP BY ALL) USING (batch, agent_mode)""", f"{X.ROUNDS}, {_GRID}", "mean_tokens_1 mean_tokens_2 mean_tokens_3")
def round_matrix(spark, d):
    run = _C("run")
    dims = {"batch": run % 2, "agent_mode": F.when(run % 5 < 3, "multi").otherwise("single")}
    rows = rounds(spark, d).withColumns(dims)
    usage = rows.select("batch", "agent_mode", "run").distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return E.round_matrix(rows, usage.withColumn("tokens", F.when(~((_C("round") == 3) & (run % 10 == 4)), run * 10 + _C("round"))), ["batch", "agent_mode"], 3)


def _transition_sql(source, keys):
    return f"""SELECT {keys}, count(*) AS count, count(a) AS first_known_count, count(b) AS final_known_count, count(*) FILTER (a) AS first_success_count, count(*) FILTER (b) AS final_success_count, count(*) FILTER (a) * 100e0 / nullif(count(a), 0) AS first_success_rate_pct, count(*) FILTER (b) * 100e0 / nullif(count(b), 0) AS final_success_rate_pct,
        count(*) FILTER (a AND b) AS retained_count, count(*) FILTER (NOT a AND b) AS gained_count, count(*) FILTER (a AND NOT b) AS lost_count, count(*) FILTER (NOT a AND NOT b) AS never_count, count(*) FILTER (a IS NULL OR b IS NULL) AS unknown_transition_count FROM {source} GROUP BY {keys}"""


_RATES = "first_success_rate_pct final_success_rate_pct"


@query("agg_transitions", _transition_sql("(SELECT batch, mode, first_success AS a, final_success AS b FROM runs)", "batch, mode"), X.RUNS, _RATES)
def transitions(spark, d):
    return E.transitions(X.runs(spark, d), ["batch", "mode"], "first_success", "final_success")


_ENDS = f"""ends AS (SELECT run, zone, "window", {_BM}, bool_and(medium) FILTER (round = 1) AS a, bool_and(medium) FILTER (round = 3) AS b FROM grid GROUP BY run, zone, "window"),
of_zones AS (SELECT run, zone, batch, agent_mode, {_ALL.format('a')} AS a, {_ALL.format('b')} AS b, CASE WHEN run % 9 <> 4 THEN run % 4 END AS attempts FROM ends GROUP BY ALL),
of_runs AS (SELECT run, batch, agent_mode, {_ALL.format('a')} AS a, {_ALL.format('b')} AS b, run % 4 AS attempts, CASE WHEN run % 50 <> 7 THEN run % 6 END AS calls, CASE WHEN run % 40 <> 9 THEN run * 10 END AS prompt_tokens, run * 3 AS completion_tokens, run % 40 <> 9 AS ok FROM of_zones GROUP BY ALL)"""
_SCOPES = [("run", "of_runs"), ("zone", "of_zones"), ("window", "ends")]
_SUMMED = {s: _transition_sql(v, "batch, agent_mode").replace(" AS ", f" AS {s}_") for s, v in _SCOPES}
_RATES3 = " ".join(f"{s}_{r}" for s, _ in _SCOPES for r in _RATES.split())
_MEANS = ", ".join(f"{t}, known_{t}, " + ", ".join(f"{t} / nullif({c}, 0) AS mean_{t}_per_{s}" for s, c in (("run", "run_count"), ("zone", "zone_count"), ("call", "agent_call_count"))) for t in E.TOKENS)
_MEAN_NAMES = " ".join(f"mean_{t}_per_{s}" for t in E.TOKENS for s in ("run", "zone", "call"))


@query("agg_agent_summary", f"""SELECT r.*, z.* EXCLUDE (batch, agent_mode), w.* EXCLUDE (batch, agent_mode), agent_call_count, token_usage_complete, incomplete_usage_run_count, attempts / run_count AS mean_attempts_per_run, zone_attempts / zone_count AS mean_attempts_per_zone, agent_call_count / run_count AS mean_calls_per_run, agent_call_count / zone_count AS mean_calls_per_zone, {_MEANS}
    FROM ({_SUMMED['run']}) r JOIN ({_SUMMED['zone']}) z USING (batch, agent_mode) JOIN ({_SUMMED['window']}) w USING (batch, agent_mode)
    JOIN (SELECT batch, agent_mode, CASE WHEN count(attempts) = count(*) THEN sum(attempts) END AS attempts, CAST(CASE WHEN count(calls) = count(*) THEN sum(calls) END AS BIGINT) AS agent_call_count, bool_and(ok) AS token_usage_complete, count(*) FILTER (NOT ok) AS incomplete_usage_run_count, {", ".join(f"CAST(sum({t}) AS BIGINT) AS known_{t}, CAST(CASE WHEN bool_and(ok) THEN sum({t}) END AS BIGINT) AS {t}" for t in E.TOKENS)} FROM of_runs GROUP BY ALL) u USING (batch, agent_mode)
    JOIN (SELECT batch, agent_mode, CASE WHEN count(attempts) = count(*) THEN sum(attempts) END AS zone_attempts FROM of_zones GROUP BY ALL) v USING (batch, agent_mode)""", f"{X.ROUNDS}, {_GRID}, {_ENDS}", f"{_RATES3} mean_attempts_per_run mean_attempts_per_zone mean_calls_per_run mean_calls_per_zone {_MEAN_NAMES}")
def agent_summary(spark, d):
    """Windows succeed in a round if they are in the band, zones and runs if all their windows do."""
    run, keys = _C("run"), ["batch", "agent_mode"]
    at = lambda n: F.bool_and(F.when(_C("round") == n, _C("medium")))
    dims = {"batch": run % 2, "agent_mode": F.when(run % 5 < 3, "multi").otherwise("single")}
    windows = checkpoint(rounds(spark, d).groupBy(*_WK).agg(at(1).alias("first_success"), at(3).alias("final_success")).withColumns(dims))
    flags = ["first_success", "final_success"]
    zones = E.all_success(windows, [*keys, "run", "zone"], flags).withColumn("attempts_used", F.when(run % 9 != 4, run % 4))
    usage = {"attempts_used": run % 4, "agent_call_count": F.when(run % 50 != 7, run % 6), "prompt_tokens": F.when(run % 40 != 9, run * 10), "completion_tokens": run * 3, "token_usage_complete": run % 40 != 9}
    return E.agent_summary(E.all_success(zones, [*keys, "run"], flags).withColumns(usage), zones, windows, keys)


_TOK = "complete AS (SELECT *, coalesce(token_usage_complete, true) AND prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL AS ok, CASE WHEN prompt_tokens IS NOT NULL AND cached_tokens <= prompt_tokens THEN cached_tokens END AS u FROM agent_calls)"
_USE = "count(*) AS calls, bool_and(ok) AS token_usage_complete, count(*) FILTER (NOT ok) AS incomplete_rows, " + ", ".join(f"CASE WHEN bool_and(ok) THEN CAST(sum({t}) AS BIGINT) END AS {t}, CAST(sum({t}) AS BIGINT) AS known_{t}, CASE WHEN bool_and(ok) THEN avg({t}) END AS mean_{t}, CASE WHEN bool_and(ok) THEN quantile_cont({t}, 0.5) END AS median_{t}, CASE WHEN bool_and(ok) THEN quantile_cont({t}, 0.95) END AS p95_{t}, quantile_cont({t}, 0.95) AS known_p95_{t}" for t in E.TOKENS)
_USE_DOUBLES = " ".join(f"mean_{t} median_{t} p95_{t} known_p95_{t}" for t in E.TOKENS)
_VIEWS = f"{X.CALLS}, {_TOK}"


@query("agg_usage_summary", f"SELECT run, {_USE} FROM complete GROUP BY run", _VIEWS, _USE_DOUBLES)
def usage_summary(spark, d):
    return E.usage_summary(X.agent_calls(spark, d), ["run"])


#: Dimensions of calls in SQL: those of the run or attempt, and those of the call.
_CALL_DIMS = {"batch": "run % 2", "dataset": "'set-' || run % 3", "agent_mode": "CASE WHEN run % 5 < 3 THEN 'multi' ELSE 'single' END", "backend": "CASE WHEN run % 4 < 2 THEN 'ar' ELSE 'ridge' END", "forecast_origin": "run % 7", "zone_id": "'z' || step % 4", "stage": "'stage-' || step % 3", "is_repair": "step % 5 = 3", "discussion_round": "step // 4"}
_CONTEXT = ["batch", "dataset", "backend", "agent_mode"]
ROUND_SETS = {"usage_by_batch": ["batch"], "usage_by_dataset": ["batch", "dataset"], "usage_by_mode": ["batch", "agent_mode"], "usage_by_dataset_model_mode": _CONTEXT, "usage_by_origin": [*_CONTEXT, "forecast_origin"], "tokens_by_mode_round": [*_CONTEXT, "attempt"]}
CALL_SETS = {"usage_by_zone": [*_CONTEXT, "zone_id"], "usage_by_stage": [*_CONTEXT, "stage", "is_repair"], "usage_by_agent": [*_CONTEXT, "agent"], "usage_by_discussion_round": [*_CONTEXT, "discussion_round"], "usage_by_repair": [*_CONTEXT, "is_repair"]}
_DIMMED = f"{_VIEWS}, dimmed AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _CALL_DIMS.items())} FROM complete)"
_KEY_SQL = lambda cs: " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in cs)
_PER_RUN = ", ".join(f"{t} / run_count AS mean_{t}_per_run" for t in E.TOKENS)
_PER_RUN_NAMES = " ".join(f"mean_{t}_per_run" for t in E.TOKENS)


def dimmed_calls(spark, d):
    run, step = _C("run"), _C("step")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return X.agent_calls(spark, d).withColumns({
        "batch": run % 2, "dataset": text("set-", run % 3), "agent_mode": F.when(run % 5 < 3, "multi").otherwise("single"), "backend": F.when(run % 4 < 2, "ar").otherwise("ridge"), "forecast_origin": run % 7,
        "zone_id": text("z", step % 4), "stage": text("stage-", step % 3), "is_repair": step % 5 == 3, "discussion_round": F.floor(step / 4).cast("long"),
    })


@query("agg_usage_tables", " UNION ALL ".join(f"SELECT *, {_PER_RUN} FROM (SELECT '{n}' AS level, {_KEY_SQL(cs)} AS key, {_USE}, count(DISTINCT run) AS run_count FROM dimmed GROUP BY ALL)" for n, cs in CALL_SETS.items()), _DIMMED, f"{_USE_DOUBLES} {_PER_RUN_NAMES}")
def usage_tables(spark, d):
    """The five groupings of calls, with distributions, in one pass."""
    return E.call_tables(dimmed_calls(spark, d), CALL_SETS)


_ROUND_SUMS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS known_{t}, CASE WHEN bool_and(ok) THEN CAST(sum({t}) AS BIGINT) END AS {t}" for t in E.TOKENS)


@query("agg_usage_round_tables", " UNION ALL ".join(f"SELECT *, {_PER_RUN} FROM (SELECT '{n}' AS level, {_KEY_SQL(cs)} AS key, count(DISTINCT (run, attempt)) AS rounds, count(*) AS agent_call_count, bool_and(ok) AS token_usage_complete, count(DISTINCT (run, attempt)) FILTER (NOT ok) AS incomplete_rounds, {_ROUND_SUMS}, count(DISTINCT run) AS run_count FROM dimmed GROUP BY ALL)" for n, cs in ROUND_SETS.items()), _DIMMED, _PER_RUN_NAMES)
def usage_round_tables(spark, d):
    """The six groupings of rounds in one pass."""
    return E.round_tables(dimmed_calls(spark, d), ROUND_SETS)


_CACHE_OK = "bool_and(u IS NOT NULL AND token_usage_complete)"


@query("agg_cache_usage", f"SELECT agent, CASE WHEN {_CACHE_OK} THEN CAST(sum(u) AS BIGINT) END AS cached_tokens, CAST(sum(coalesce(u, 0)) AS BIGINT) AS known_cached_tokens, count(*) FILTER (u IS NOT NULL AND token_usage_complete) AS cache_reported_call_count, {_CACHE_OK} AS cache_usage_complete, CASE WHEN {_CACHE_OK} AND sum(prompt_tokens) > 0 THEN sum(u) / sum(prompt_tokens) END AS cache_hit_ratio FROM complete GROUP BY agent", _VIEWS, "cache_hit_ratio")
def cache_usage(spark, d):
    return E.cache_summary(X.agent_calls(spark, d), ["agent"])


_ROUND_USE = "SELECT run, attempt, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS known_prompt_tokens, bool_and(ok) AS complete, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents FROM complete GROUP BY run, attempt"


@query("agg_round_usage", f"SELECT *, CAST(sum(calls) OVER w AS BIGINT) AS cumulative_calls, CAST(sum(known_prompt_tokens) OVER w AS BIGINT) AS cumulative_prompt_tokens, bool_and(complete) OVER w AS cumulative_complete FROM ({_ROUND_USE}) WINDOW w AS (PARTITION BY run ORDER BY attempt)", _VIEWS)
def round_usage(spark, d):
    return E.round_usage(X.agent_calls(spark, d))


@query("agg_usage_audit", """SELECT run, CASE WHEN fields <> '' THEN 'mismatch' WHEN unknown THEN 'partial' ELSE 'match' END AS status, fields FROM (SELECT run, NOT ok OR tokens IS NULL OR recorded_tokens IS NULL AS unknown, array_to_string(list_filter([CASE WHEN calls <> recorded_calls THEN 'calls' END, CASE WHEN tokens <> recorded_tokens THEN 'tokens' END], lambda x: x IS NOT NULL), ',') AS fields
    FROM (SELECT run, count(*) AS calls, sum(prompt_tokens) AS tokens, bool_and(ok) AS ok, count(*) + CASE WHEN run % 10 = 1 THEN 1 ELSE 0 END AS recorded_calls, CASE WHEN run % 8 <> 5 THEN sum(prompt_tokens) + CASE WHEN run % 6 = 2 THEN 3 ELSE 0 END END AS recorded_tokens FROM complete GROUP BY run))""", _VIEWS)
def usage_audit(spark, d):
    calls = X.agent_calls(spark, d)
    run = _C("run")
    recorded = calls.groupBy("run").agg((F.count("*") + F.when(F.first(run % 10) == 1, 1).otherwise(0)).alias("recorded_calls"), F.when(F.first(run % 8) != 5, F.sum("prompt_tokens") + F.when(F.first(run % 6) == 2, 3).otherwise(0)).alias("recorded_tokens"))
    return E.usage_audit(calls, recorded)


@query("prj_provider_usage", """SELECT run, step, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, cached AS cached_tokens FROM (SELECT conv_id AS run, turn AS step, length(text) + CASE WHEN turn % 2 = 1 THEN length(text) // 4 + length(text) // 5 ELSE 0 END AS p, length(text) // 2 AS c, length(text) // 4 AS cached FROM conversations)""")
def provider_usage(spark, d):
    """Two payload shapes: one total, or three input parts that add up."""
    n = F.length("text")
    part = lambda k: F.floor(n / k).cast("long")
    total = F.to_json(F.struct(F.struct(n.alias("prompt_tokens"), part(2).alias("completion_tokens"), F.struct(part(4).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")))
    parts = F.to_json(F.struct(F.struct(n.alias("input_tokens"), part(2).alias("output_tokens"), part(4).alias("cache_read_input_tokens"), part(5).alias("cache_creation_input_tokens")).alias("usage")))
    rows = X.table(spark, d, "conversations").select(_C("conv_id").alias("run"), _C("turn").alias("step"), F.when(_C("turn") % 2 == 1, parts).otherwise(total).alias("payload"))
    return rows.select("run", "step", *[c.alias(n) for n, c in PV.provider_usage(_C("payload")).items()])


_BODY = """'{"n":' || length(text) || ',"reasoning":"secret","inner":{"Thoughts ":"x","turn":' || turn || ',"thinking":"y"},"analysis":[1]}'"""


@query("prj_response_json", f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || {_BODY} || chr(10) || '```' || chr(10) ELSE 'so ' || {_BODY} || ' end' END AS response, '{{"inner": {{"thinking": "y", "turn": ' || turn || '}}, "n": ' || length(text) || '}}' AS object FROM conversations""")
def response_json(spark, d):
    """The JSON object in a response, fenced or bare, without the keys of hidden reasoning."""
    inner = F.struct(F.lit("x").alias("Thoughts "), _C("turn").alias("turn"), F.lit("y").alias("thinking"))
    body = F.to_json(F.struct(F.length("text").alias("n"), F.lit("secret").alias("reasoning"), inner.alias("inner"), F.array(F.lit(1)).alias("analysis")))
    text = F.when(_C("turn") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).otherwise(F.concat(F.lit("so "), body, F.lit(" end")))
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", text.alias("response"))
    from ..functions.text import response_object

    return rows.withColumn("object", response_object("response"))


@query("prj_forecast_params", "SELECT o_orderkey AS run, round((o_orderkey % 97) / 96e0, 6) AS alpha, CASE WHEN o_orderkey % 2 = 0 THEN 'ar' ELSE 'ridge' END AS backend, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 9 END AS calibration_days, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 5 END AS ridge_penalty FROM orders")
def forecast_params(spark, d):
    """Saved parameters as JSON of older and newer names, to one form; other backends' keys are dropped."""
    k = _C("o_orderkey")
    raw = F.to_json(F.struct(F.when(k % 2 == 0, (k % 97) / 96).alias("blend_alpha"), F.when(k % 2 == 1, (k % 97) / 96).alias("alpha"), F.when(k % 2 == 0, "ar").otherwise("ridge").alias("backend"), (k % 9).alias("calibration_days"), (k % 3 != 0).alias("validation_bias"), (k % 5).alias("ridge_penalty"), F.lit(7).alias("tree_depth")))
    rows = X.table(spark, d, "orders").select(k.alias("run"), raw.alias("raw"))
    return rows.select("run", *[c.alias(n) for n, c in PV.forecast_parameters(_C("raw")).items()])


@query("prj_dataset_identity", "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 3 = 0 THEN 'set-' || o_orderkey % 7 ELSE 'file-' || o_orderkey % 5 END AS dataset, CASE WHEN o_orderkey % 2 = 0 THEN 'RMB/kWh' ELSE 'unknown' END AS price_unit, o_orderkey % 3 = 0 AS from_manifest FROM orders")
def dataset_identity(spark, d):
    k = _C("o_orderkey")
    rows = X.table(spark, d, "orders").select(k.alias("run"), F.when(k % 3 == 0, F.concat(F.lit("set-"), (k % 7).cast("string"))).alias("name"), F.concat(F.lit("/data/file-"), (k % 5).cast("string"), F.lit(".csv")).alias("path"), F.when(k % 2 == 0, "RMB/kWh").alias("unit"))
    return rows.select("run", *[c.alias(n) for n, c in PV.dataset_identity(_C("name"), _C("path"), _C("unit")).items()])


_COHORTS = """SELECT batch, identity, reason IS NULL AS accepted, reason FROM (SELECT batch, identity, CASE WHEN n > have THEN 'duplicate_mode' WHEN have < modes THEN 'missing_mode' WHEN unknown > 0 THEN 'unknown_signature' WHEN signatures > 1 THEN 'inconsistent_signature' END AS reason
    FROM (SELECT batch, identity, count(DISTINCT mode) AS have, count(*) AS n, count(DISTINCT signature) AS signatures, count(*) - count(signature) AS unknown FROM runs GROUP BY ALL) JOIN (SELECT batch, count(DISTINCT mode) AS modes FROM runs GROUP BY batch) USING (batch))"""
_PAIRS = """pairs AS (SELECT coalesce(a.lb, b.lb) AS left_batch, coalesce(a.rb, b.rb) AS right_batch, coalesce(a.identity, b.identity) AS identity, coalesce(a.mode, b.mode) AS mode, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'missing' WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' WHEN a.u OR b.u THEN 'unknown' WHEN a.s <> b.s THEN 'inconsistent' ELSE 'matched' END AS status
    FROM (SELECT lb, rb, one.* FROM two JOIN one ON one.batch = lb) a FULL JOIN (SELECT lb, rb, one.* FROM two JOIN one ON one.batch = rb) b ON a.lb = b.lb AND a.rb = b.rb AND a.identity = b.identity AND a.mode = b.mode)"""
_TWO = "two AS (SELECT DISTINCT a.batch AS lb, b.batch AS rb FROM runs a, runs b WHERE a.batch < b.batch), one AS (SELECT batch, identity, mode, count(*) AS n, max(signature) AS s, min(signature) IS NULL AS u FROM runs GROUP BY ALL)"


def evidence(spark, d):
    """Pairing evidence of each saved run (an order): content follows its identity, but for runs whose prices differ
    (every 29th) or whose last hour is missing (every 31st). Runs are dealt once; all tables are made of them where they are."""
    orders = X.table(spark, d, "orders").count()
    runs = dealt(X.runs(spark, d).select(_C("k").alias("run"), "identity"), orders, ["run"], 50_000)
    every = runs.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(1))))
    zones = every.withColumn("zone_id", F.concat(F.lit("z"), _C("zone").cast("string")))
    # Three windows' times and hours as literals: adding intervals to times row by row took most of the work.
    time = lambda h: F.lit(f"2024-01-01 {h:02}:00:00").cast("timestamp_ntz")
    every = F.array(*[F.struct(F.lit(i).alias("slot"), time(3 * i).alias("start"), time(3 * i + 2).alias("end"), F.array(*[time(3 * i + j) for j in range(3)]).alias("hours")) for i in range(3)])
    slots = zones.select("*", F.inline(F.slice(every, F.lit(1), (_C("identity") % 3 + 1).cast("int"))))
    windows = slots.select("run", "zone_id", "identity", _C("start").alias("window_start"), _C("end").alias("window_end"), "hours", ((_C("identity") % 97 + _C("slot")) / 100 + F.when(_C("run") % 29 == 0, 0.5).otherwise(0.0)).alias("mean_energy_price"), (_C("identity") * 1.5 + _C("slot")).alias("sum_predicted_kwh"), F.lit("Medium").alias("load_stress_level"))
    hourly = windows.withColumn("time", F.explode("hours"))
    gap = (_C("run") % 31 == 0) & (_C("zone_id") == "z1") & (_C("time") == F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))
    hourly = hourly.where(~gap).select("run", "zone_id", "time", (_C("identity") + F.hour("time")).cast("double").alias("actual_kwh"), (_C("identity") * 0.5).alias("predicted_kwh"), _C("mean_energy_price").alias("e_price"))
    thresholds = zones.select("run", "zone_id", (_C("identity") % 50 + 1.0).alias("low_medium_kwh"), (_C("identity") % 50 + 9.0).alias("medium_high_kwh"))
    parameters = runs.select("run", F.create_map(F.lit("alpha"), F.lit("0.5")).alias("parameters"))
    return PE.pairing_evidence(windows, windows, thresholds, hourly, parameters, ["e_price"])


@query("join_mode_cohort", _COHORTS, X.RUNS)
def mode_cohort(spark, d):
    """Runs with a signature from their pairing evidence: none where that isn't ready."""
    found = evidence(spark, d).select(_C("run").alias("k"), F.when(_C("pairing_ready"), F.sha2(F.concat_ws("-", "baseline_signature", "hourly_signature", "parameters_signature"), 256)).alias("signature"))
    return E.mode_cohorts(X.runs(spark, d).drop("signature").join(found, "k"))


@query("join_batch_pairs", "SELECT * FROM pairs", f"{X.RUNS}, {_TWO}, {_PAIRS}")
def batch_pairs(spark, d):
    return E.batch_pairs(X.runs(spark, d))


@query("agg_paired_summary", """SELECT *, right_ok - left_ok AS delta_ok, right_tokens - left_tokens AS delta_tokens FROM (SELECT left_batch, right_batch, mode, count(*) AS pairs, CASE WHEN count(*) = count(lo) THEN CAST(sum(CAST(lo AS BIGINT)) AS BIGINT) END AS left_ok, CASE WHEN count(*) = count(lt) THEN CAST(sum(lt) AS BIGINT) END AS left_tokens, CASE WHEN count(*) = count(ro) THEN CAST(sum(CAST(ro AS BIGINT)) AS BIGINT) END AS right_ok, CASE WHEN count(*) = count(rt) THEN CAST(sum(rt) AS BIGINT) END AS right_tokens
    FROM (SELECT p.*, l.final_success AS lo, l.tokens AS lt, r.final_success AS ro, r.tokens AS rt FROM pairs p JOIN runs l ON l.batch = left_batch AND l.identity = p.identity AND l.mode = p.mode JOIN runs r ON r.batch = right_batch AND r.identity = p.identity AND r.mode = p.mode WHERE status = 'matched') GROUP BY ALL)""", f"{X.RUNS}, {_TWO}, {_PAIRS}")
def paired_summary(spark, d):
    runs = X.runs(spark, d)
    return E.paired_summary(runs, E.batch_pairs(runs))


_EVIDENCE_SQL = """WITH w AS (
    SELECT k AS run, identity, 'z' || zone AS zone_id, TIMESTAMP '2024-01-01' + INTERVAL 3 HOUR * slot AS a, TIMESTAMP '2024-01-01' + INTERVAL 3 HOUR * slot + INTERVAL 2 HOUR AS b, (identity % 97 + slot) / 100e0 + CASE WHEN k % 29 = 0 THEN 0.5e0 ELSE 0e0 END AS price, identity * 1.5e0 + slot AS load
    FROM (SELECT *, unnest(range(0, identity % 3 + 1)) AS slot FROM (SELECT *, unnest([0, 1]) AS zone FROM runs))),
hours AS (SELECT *, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS time FROM w),
hourly AS (SELECT * FROM hours WHERE NOT (run % 31 = 0 AND zone_id = 'z1' AND time = TIMESTAMP '2024-01-01 02:00:00'))
SELECT run, 2 AS zones, true AS complete, n = m AS covered, n = m AS pairing_ready, count(*) OVER (PARTITION BY base) AS equal_baselines, CASE WHEN n = m THEN count(*) OVER (PARTITION BY n = m, hash) ELSE 0 END AS equal_hours FROM (
    SELECT run, identity % 97 || '/' || identity || '/' || (run % 29 = 0) AS base, identity || '/' || (run % 29 = 0) AS hash, (SELECT count(*) FROM hourly h WHERE h.run = r.run) AS n, (SELECT count(*) FROM hours h WHERE h.run = r.run) AS m FROM (SELECT k AS run, identity FROM runs) r)"""


@query("agg_pairing_signature", _EVIDENCE_SQL, X.RUNS)
def pairing_signature(spark, d):
    """Evidence per run. Hashes show as the number of runs that share them, which SQL tells from the content itself."""
    got = checkpoint(evidence(spark, d).drop("parameters_signature"))
    for name, c in (("equal_baselines", "baseline_signature"), ("equal_hours", "hourly_signature")):
        got = got.join(got.where(_C(c).isNotNull()).groupBy(c).agg(F.count("*").alias(name)), c, "left")
    return got.select("run", "zones", "complete", _C("hourly_signature").isNotNull().alias("covered"), "pairing_ready", F.coalesce("equal_baselines", F.lit(0)).alias("equal_baselines"), F.coalesce("equal_hours", F.lit(0)).alias("equal_hours"))


@query("agg_control_summary", f"SELECT run, CASE WHEN {_ALL.format('ok')} THEN 'success' WHEN {_ALL.format('ok')} IS NULL THEN 'unknown' ELSE 'fail' END AS status, count(*) AS zones, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, max(last) AS max_attempts FROM (SELECT run, zone, {_ALL.format('medium')} AS ok, max(CASE WHEN source <> 'missing' THEN round END) AS last FROM grid WHERE round > 0 GROUP BY run, zone) GROUP BY run", f"{X.ROUNDS}, {_GRID}")
def control_summary(spark, d):
    return E.control_summary(rounds(spark, d))


@query("agg_decision_quality", """SELECT source, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / sqrt(count(value)) AS sem, min(value) AS min, max(value) AS max FROM (
    SELECT 'windows' AS source, 'load_kwh' AS metric, load_kwh AS value FROM grid UNION ALL SELECT 'windows', 'medium', CAST(medium AS DOUBLE) FROM grid UNION ALL SELECT 'calls', 'prompt_tokens', prompt_tokens FROM agent_calls UNION ALL SELECT 'calls', 'completion_tokens', completion_tokens FROM agent_calls) GROUP BY ALL""", f"{X.ROUNDS}, {_GRID}, {X.CALLS}", "mean std sem min max")
def decision_quality(spark, d):
    windows = rounds(spark, d).select(F.lit("windows").alias("source"), "load_kwh", _C("medium").cast("int").cast("double").alias("medium"))
    calls = X.agent_calls(spark, d).select(F.lit("calls").alias("source"), _C("prompt_tokens").cast("double").alias("prompt_tokens"), _C("completion_tokens").cast("double").alias("completion_tokens"))
    return summary(windows, ["source"], ["load_kwh", "medium"]).unionByName(summary(calls, ["source"], ["prompt_tokens", "completion_tokens"]))


_NEAR = "count(*) FILTER (abs(l_discount - l_tax) <= abs(l_tax) * 0.08e0)"


@query("agg_price_comparison", f"SELECT l_returnflag AS category, l_suppkey AS zone_id, count(*) AS windows, {_NEAR} AS within_pct, {_NEAR} * 100e0 / count(*) AS accuracy_pct, avg(l_discount) AS mean_predicted, avg(l_tax) AS mean_baseline, avg(l_discount - l_tax) AS mean_difference, avg(CASE WHEN l_tax <> 0 THEN (l_discount - l_tax) / l_tax * 100 END) AS mean_difference_pct FROM lineitem GROUP BY ALL", "", "accuracy_pct mean_predicted mean_baseline mean_difference mean_difference_pct")
def price_comparison(spark, d):
    rows = X.table(spark, d, "lineitem").select(_C("l_returnflag").alias("category"), _C("l_suppkey").alias("zone_id"), _C("l_discount").alias("predicted_price"), _C("l_tax").alias("baseline_price"))
    return E.price_comparison(rows, ["category", "zone_id"])


def saved(spark, d):
    """Window rounds and final windows as nested results of three versions below a new folder, one run per line, told by its
    ``batch``. The rounds are read once: each window's are gathered, then laid out again as its zone's attempts."""
    folder = shared_folder(spark)
    state = F.struct("round", "load_kwh", "stress")
    finals = X.run_finals(X.window_rounds(spark, d), every=F.collect_list(state), base=F.max(F.when(_C("round") == 0, F.struct("load_kwh", "stress"))))
    cell = [F.concat(F.lit("w"), _C("window").cast("string")).alias("window_start"), F.concat(F.lit("e"), _C("window").cast("string")).alias("window_end")]
    later = lambda s: [s["load_kwh"].alias("reforecast_load_kwh"), s["stress"].alias("reforecast_load_stress_level")]
    ending = F.struct(*cell, _C("base.load_kwh").alias("sum_predicted_kwh"), _C("base.stress").alias("load_stress_level"), *later({"load_kwh": _C("load_kwh"), "stress": _C("stress")}))
    at = lambda n: lambda w: F.transform(F.filter(w["every"], lambda r: r["round"] == n), lambda r: F.struct(*[w[c].alias(c) for c in ("window_start", "window_end")], *later(r)))
    attempts = F.array(*[F.struct(F.lit(n).cast("long").alias("attempt"), F.flatten(F.transform("__windows", at(n))).alias("windows")) for n in (1, 2, 3)])
    made = F.filter(attempts, lambda a: F.size(a["windows"]) > 0)
    last = finals.groupBy("run", "zone", "status", "attempts_used", "attempt_limit").agg(F.collect_list(ending).alias("final_windows"), F.collect_list(F.struct(*cell, "every")).alias("__windows"))
    last = last.withColumn("attempt_trace", made).withColumn("attempt_trace", F.when(F.size("attempt_trace") > 0, _C("attempt_trace")))
    zone = F.struct(_C("zone").cast("string").alias("zone_id"), "attempts_used", "attempt_trace", "final_windows")
    nested = last.groupBy("run", "status", "attempts_used", "attempt_limit").agg(F.collect_list(zone).alias("zones"))
    old = _C("run") % 3 == 0
    named = [F.when(old, "day").alias("forecast_start"), F.when(~old, "day").alias("forecast_origin")]
    nested.select(_C("run").cast("string").alias("batch"), (_C("run") % 3 + 2).alias("schema_version"), *named, "status", "attempts_used", "attempt_limit", "zones").write.json(folder)
    return folder


@query("job_window_evaluation", """SELECT run, count(*) AS windows, count(*) FILTER (medium) AS final_medium, count(*) - count(medium) AS final_unknown, count(*) FILTER (NOT baseline_medium AND medium) AS newly_medium, count(*) FILTER (known AND first_entry_round IS NOT NULL) AS entered, count(*) FILTER (ever_medium AND NOT medium) AS ever_medium_final_exit,
    CAST(sum(carried) AS BIGINT) AS carried_rounds FROM finals JOIN (SELECT run, zone, "window", count(*) FILTER (source = 'early_stop_carry') AS carried FROM grid GROUP BY ALL) USING (run, zone, "window") GROUP BY run""", f"{X.ROUNDS}, {_GRID}")
def window_evaluation(spark, d):
    """Saved nested results of all versions, read back through the library's reader, to outcomes: rounds with early stops
    carried on and final windows, in one pass."""
    flat, finals = RS.rounds_of(RS.read_results(spark, saved(spark, d))[0], ["batch"])
    number = lambda df: df.select(_C("batch").cast("long").alias("run"), _C("zone_id").cast("long").alias("zone"), F.substring("window_start", 2, 9).cast("long").alias("window"), *[c for c in df.columns if c in ("round", "status", "attempts_used", "attempt_limit", "load_kwh", "stress")])
    every = E.outcome_history(number(flat), _WK, 3, number(finals))
    last, m, b = _C("phase") == "final", _C("medium"), _C("baseline_medium")
    return every.groupBy("run").agg(
        F.count_if(last).alias("windows"), F.count_if(last & m).alias("final_medium"), F.count_if(last & m.isNull()).alias("final_unknown"), F.count_if(last & ~b & m).alias("newly_medium"),
        F.count_if(last & _C("first_entry_known") & _C("first_entry_round").isNotNull()).alias("entered"), F.count_if(last & _C("ever_medium") & ~m).alias("ever_medium_final_exit"), F.count_if(_C("source") == "early_stop_carry").alias("carried_rounds"),
    ).where("windows > 0")


@query("fn_content_fingerprint", """SELECT zone_id, sha256(string_agg(h, chr(10) ORDER BY part)) AS signature, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT zone_id, substr(h, 1, 2) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM (
    SELECT zone_id, sha256('{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.000') || '","load_kwh":' || CAST(load_kwh AS DOUBLE) || ',"energy_price":' || energy_price || ',"history_days":14}') AS h FROM zone_series) GROUP BY zone_id, part) GROUP BY zone_id""", X.SERIES)
def content_fingerprint(spark, d):
    """A hash of a zone's rows and the parameters: equal content, equal hash, in any order."""
    return E.signatures(X.zone_series(spark, d).withColumn("history_days", F.lit(14)), ["zone_id"], ["timestamp", "load_kwh", "energy_price", "history_days"])


_DECISIONS = """SELECT run, zone, round, sha256(string_agg(path || '=' || value, chr(10) ORDER BY path || '=' || value)) AS signature FROM (
    SELECT DISTINCT run, zone, round, '' AS path, '{' AS value FROM grid UNION ALL SELECT DISTINCT run, zone, round, '/windows', '[' FROM grid
    UNION ALL SELECT run, zone, round, '/windows/' || i, '{' FROM numbered UNION ALL SELECT run, zone, round, '/windows/' || i || '/window', 'n:' || printf('%.6f', "window" :: DOUBLE) FROM numbered
    UNION ALL SELECT run, zone, round, '/windows/' || i || '/load', 'n:' || printf('%.6f', load_kwh :: DOUBLE) FROM numbered WHERE load_kwh IS NOT NULL UNION ALL SELECT run, zone, round, '/windows/' || i || '/stress', 's:' || stress FROM numbered WHERE stress IS NOT NULL) GROUP BY run, zone, round"""


@query("fn_decision_signature", f"""SELECT *, coalesce(signature = lag(signature) OVER (PARTITION BY run, zone ORDER BY round), false) AS converged FROM ({_DECISIONS})""", f"""{X.ROUNDS}, {_GRID}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run, zone, round ORDER BY "window") - 1 AS i FROM grid)""")
def decision_signature(spark, d):
    """A round's decisions as nested JSON with explanations that change from round to round; equal to the previous
    round's without them: converged."""
    window = F.struct("window", _C("load_kwh").alias("load"), "stress", F.concat(F.lit("round "), _C("round").cast("string")).alias("message_to_other_agents"))
    decisions = F.to_json(F.struct(F.concat(F.lit("because "), _C("round").cast("string")).alias("reasoning_summary"), F.sort_array(F.collect_list(window)).alias("windows")))
    return CF.decision_signatures(rounds(spark, d).groupBy("run", "zone", "round").agg(decisions.alias("decisions")), ["run", "zone"], "decisions", "round")


@query("udf_run_analyzer", """SELECT '{"batch":' || batch || ',"mode":' || mode || ',"identity":' || identity || ',"tokens":' || coalesce(CAST(tokens AS VARCHAR), 'null') || '}' AS record,
    '{"cheap": ' || CASE WHEN coalesce(tokens, 0) < 2000 THEN 'true' ELSE 'false' END || ', "key": "' || batch || '-' || identity || '"}' AS analysis FROM runs""", X.RUNS)
def run_analyzer(spark, d):
    """A user's function over run records."""
    from ..functions.text import analyzed

    records = X.runs(spark, d).select("batch", "mode", "identity", "tokens")
    return analyzed(records, lambda r: {"key": f"{r['batch']}-{r['identity']}", "cheap": (r["tokens"] or 0) < 2000})

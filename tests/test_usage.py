"""Usage tables, price comparison, provenance and whole rows of copies on literal rows."""

from pyspark.sql import functions as F

from zoneload.functions import provenance as PV
from zoneload.operators import evaluation as E

CALLS = "run int, attempt int, agent string, batch int, prompt_tokens long, completion_tokens long, cached_tokens long, token_usage_complete boolean"


def test_call_and_round_tables(spark):
    rows = [(1, 1, "a", 0, 10, 1, 0, True), (1, 2, "b", 0, 20, 2, 0, True), (2, 1, "a", 0, 30, 3, 0, None), (3, 1, "a", 1, None, 4, 0, True), (3, 1, "b", 1, 50, 5, 0, False)]
    calls = spark.createDataFrame(rows, CALLS)
    got = {(r.level, r.key): r for r in E.call_tables(calls, {"agents": ["agent"], "both": ["batch", "agent"]}).collect()}
    assert (got["both", "0/a"].calls, got["both", "0/a"].run_count, got["both", "0/a"].prompt_tokens, got["both", "0/a"].mean_prompt_tokens_per_run) == (2, 2, 40, 20.0)
    assert (got["agents", "a"].prompt_tokens, got["agents", "a"].known_prompt_tokens, got["agents", "a"].mean_prompt_tokens_per_run) == (None, 40, None)
    of = {(r.level, r.key): r for r in E.round_tables(calls, {"batches": ["batch"], "attempts": ["batch", "attempt"]}).collect()}
    assert (of["batches", "0"].rounds, of["batches", "0"].agent_call_count, of["batches", "0"].completion_tokens, of["batches", "0"].mean_completion_tokens_per_run) == (3, 3, 6, 3.0)
    assert (of["batches", "1"].rounds, of["batches", "1"].incomplete_rounds, of["batches", "1"].prompt_tokens, of["batches", "1"].known_prompt_tokens) == (1, 1, None, 50)
    assert of["attempts", "0/2"].run_count == 1


def test_copies_leave_one_whole_row(spark):
    rows = [(1, "b", 1), (1, "a", 9), (1, "a", 8), (2, None, None)]
    got = sorted(map(tuple, E.deduplicated(spark.createDataFrame(rows, "k int, x string, y int").repartition(3), ["k"]).collect()))
    assert got == [(1, "a", 8, 2), (2, None, None, 0)]


def test_price_comparison_with_a_free_baseline(spark):
    rows = [("z", 0.0, 0.0), ("z", 0.0, 0.1), ("z", 1.0, 1.07), ("z", 1.0, 1.09), ("z", None, 1.0)]
    r = E.price_comparison(spark.createDataFrame(rows, "zone string, baseline_price double, predicted_price double"), ["zone"]).first()
    assert (r.windows, r.within_pct, r.accuracy_pct) == (4, 2, 50.0) and abs(r.mean_difference_pct - 8.0) < 1e-9


def test_provenance_of_odd_texts(spark):
    raw = ['{"alpha": "0.1234567", "backend": "ar", "validation_bias": true, "calibration_days": 3, "ridge_penalty": 2}', "{}", None, '{"usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string")
    got = df.orderBy("i").select(*[c.alias(n) for n, c in PV.forecast_parameters(F.col("raw")).items()]).collect()
    assert tuple(got[0]) == (0.123457, "ar", 3, None) and tuple(got[1]) == (None, None, 0, None) and tuple(got[2]) == (None, None, 0, None)
    used = df.orderBy("i").select(*[c.alias(n) for n, c in PV.provider_usage(F.col("raw")).items()]).collect()
    assert tuple(used[3]) == (6, 2, 1, 8) and tuple(used[2]) == (None, None, None, None)
    one = df.limit(1).select(*[c.alias(n) for n, c in PV.dataset_identity(F.lit(None).cast("string"), F.lit("/a/b.csv"), F.lit(None).cast("string")).items()]).first()
    assert tuple(one) == ("b", "unknown", False)


def test_agent_summary_pools_before_means(spark):
    runs = [(0, 1, True, True, 2, 3, 10, 1, True), (0, 2, None, False, 1, 1, 20, 2, True), (1, 3, False, True, None, 2, 5, None, False)]
    zones = [(0, 1, "a", True, True, 2), (0, 1, "b", True, True, 2), (0, 2, "a", None, False, 1), (1, 3, "a", False, True, 1)]
    windows = [(0, 1, True, True), (0, 2, False, True), (0, 2, None, False), (1, 3, False, True)]
    got = E.agent_summary(
        spark.createDataFrame(runs, "batch int, run int, first_success boolean, final_success boolean, attempts_used int, agent_call_count long, prompt_tokens long, completion_tokens long, token_usage_complete boolean"),
        spark.createDataFrame(zones, "batch int, run int, zone string, first_success boolean, final_success boolean, attempts_used int"),
        spark.createDataFrame(windows, "batch int, run int, first_success boolean, final_success boolean"), ["batch"],
    )
    a, b = got.orderBy("batch").collect()
    assert (a.run_count, a.run_retained_count, a.run_unknown_transition_count, a.zone_count, a.window_count, a.window_gained_count) == (2, 1, 1, 3, 3, 1)
    assert (a.mean_attempts_per_run, round(a.mean_attempts_per_zone, 6), a.agent_call_count, a.mean_calls_per_run, a.mean_prompt_tokens_per_run, a.mean_prompt_tokens_per_zone, a.mean_prompt_tokens_per_call) == (1.5, round(5 / 3, 6), 4, 2.0, 15.0, 10.0, 7.5)
    assert (b.mean_attempts_per_run, b.mean_attempts_per_zone, b.prompt_tokens, b.known_prompt_tokens, b.known_completion_tokens, b.incomplete_usage_run_count) == (None, 1.0, None, 5, None, 1)

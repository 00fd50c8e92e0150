"""Window outcomes at several grains against plain counting of made-up rows."""

import random
from collections import Counter, defaultdict

from zoneload.operators.outcomes import with_expected, window_outcomes

ROW = """batch int, model string, run int, zone string, window int, phase string, round int, medium boolean, baseline_medium boolean, previous_medium boolean, first_entry_round int, first_entry_known boolean,
    ever_medium boolean, ever_newly_medium boolean, control_success boolean, stress string, zone_expected_window_count int, run_expected_window_count int"""
NAMES = [c.split()[0] for c in ROW.replace("\n", " ").split(", ")]


def made_up(seed, n):
    r = random.Random(seed)
    flag = lambda: r.choice([True, False, None])
    rows = []
    for _ in range(n):
        run = r.randrange(5)
        round_ = r.randrange(3)
        phase = "baseline" if round_ == 0 else r.choice(["round", "final"])
        stress = r.choice(["Low", "Medium", "High", "Extremely High", None])
        rows.append((run % 2, "ab"[run % 3 % 2], run, r.choice("xy"), r.randrange(4), phase, round_, flag(), flag(), flag(), r.choice([None, 0, 1, 2]), flag(), flag(), flag(), flag(), stress, r.choice([1, 2]), r.choice([None, 2, 3])))
    return rows


def plainly(rows, keys):
    groups = defaultdict(list)
    for x in (dict(zip(NAMES, r, strict=True)) for r in rows):
        groups[tuple(x[k] for k in [*keys, "phase", "round"])].append(x)
    for key, group in groups.items():
        know = lambda c: [x for x in group if x[c] is not None]  # noqa: E731, B023
        out = {"window_count": len(group), "medium_count": sum(x["medium"] for x in know("medium")), "medium_known_count": len(know("medium"))}
        out["new_medium_count"] = sum(x["baseline_medium"] is False and x["medium"] is True for x in group)
        out["exited_medium_count"] = sum(x["previous_medium"] is True and x["medium"] is False for x in group)
        out["never_entered_medium_count"] = sum(x["baseline_medium"] is False and x["first_entry_known"] is True and x["first_entry_round"] is None for x in group)
        out["ever_newly_medium_unknown_count"] = len(group) - len(know("ever_newly_medium"))
        out["ever_medium_final_exit_count"] = sum(x["phase"] == "final" and x["ever_medium"] is True and x["medium"] is False for x in group)
        out["control_success_count"] = sum(x["control_success"] for x in know("control_success"))
        out["stress_distribution"] = dict(Counter(x["stress"] or "Unknown" for x in group))
        out["first_entry_round_distribution"] = dict(Counter(str(x["first_entry_round"]) for x in group if x["baseline_medium"] is False and x["first_entry_known"] and x["first_entry_round"] is not None))
        out["medium_rate_pct"] = 100 * out["medium_count"] / out["medium_known_count"] if out["medium_known_count"] else None
        for level, by in (("zone", ("batch", "run", "zone")), ("run", ("batch", "run"))):
            parts = defaultdict(list)
            for x in group:
                parts[tuple(x[k] for k in by)].append(x)
            whole = [p for p in parts.values() if len({(x["zone"], x["window"]) for x in p}) >= max(x[f"{level}_expected_window_count"] or 0 for x in p) and all(x["medium"] is not None for x in p)]
            out |= {f"{level}_count": len(parts), f"{level}_complete_count": len(whole), f"{level}_unknown_count": len(parts) - len(whole), f"{level}_all_medium_count": sum(all(x["medium"] for x in p) for p in whole)}
        yield key, out


def test_outcomes_at_every_grain(spark):
    sets = {"all": ["batch"], "models": ["batch", "model"], "zones": ["batch", "model", "zone"], "runs": ["run"]}
    for seed, n in ((1, 0), (2, 1), (3, 40), (4, 400)):
        rows = made_up(seed, n)
        got = window_outcomes(spark.createDataFrame(rows, ROW), sets, 2).collect()
        found = 0
        for level, keys in sets.items():
            want = dict(plainly(rows, keys))
            mine = {tuple(r[k] for k in [*keys, "phase", "round"]): r for r in got if r["level"] == level}
            assert mine.keys() == want.keys()
            found += len(mine)
            for key, values in want.items():
                assert {k: mine[key][k] for k in values} == values
        assert found == len(got)


def test_expected_windows_are_those_of_any_round(spark):
    rows = spark.createDataFrame([(1, "a", 0, 0), (1, "a", 0, 1), (1, "a", 1, 2), (1, "b", 0, 1), (2, "a", 0, 0)], "run int, zone string, window int, round int")
    got = {(r.run, r.zone, r.zone_expected_window_count, r.run_expected_window_count) for r in with_expected(rows, ["window"]).collect()}
    assert got == {(1, "a", 2, 3), (1, "b", 1, 3), (2, "a", 1, 1)}


def test_history_in_one_pass(spark):
    """The rows of grid, history and final rows made one after the other, and no join or shuffle but one. Before, each of the steps
    joined all rounds anew."""
    from pyspark.sql import functions as F

    from zoneload.operators import evaluation as E

    keys = ["run", "zone", "window"]
    base = spark.range(4000).select((F.col("id") % 40).alias("run"), (F.col("id") % 5).alias("zone"), (F.col("id") % 7).alias("window"), (F.hash("id") % 3 + 2).cast("long").alias("round"), F.when(F.col("id") % 6 != 0, F.col("id") % 9).cast("double").alias("load_kwh"), F.when(F.col("id") % 5 != 1, F.when(F.hash("id", "id") % 2 == 0, "Medium").otherwise("Low")).alias("stress"))
    base = base.where("round < 4").dropDuplicates([*keys, "round"])
    rows = base.localCheckpoint().repartition(3, "run")
    finals = rows.groupBy(*keys).agg(F.max(F.struct("round", "load_kwh", "stress")).alias("l")).select(*keys, F.when(F.col("run") % 5 < 3, "success").otherwise("fail").alias("status"), (F.col("run") % 4).alias("attempts_used"), F.lit(3).cast("long").alias("attempt_limit"), "l.load_kwh", "l.stress")
    got = E.outcome_history(rows, keys, 3, finals)
    grid = E.round_grid(rows, keys, 3, finals)
    shown = [*keys, "round", "load_kwh", "stress", "medium", "source", "previous_medium", "first_entry_round", "first_entry_known", "ever_medium", "ever_newly_medium"]
    want = E.history_fields(grid, keys).select(*shown).unionByName(E.final_rows(grid, keys, finals).select(*shown))
    assert sorted(map(repr, got.select(*shown).collect())) == sorted(map(repr, want.collect()))
    assert got.where("phase = 'final'").count() == finals.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan

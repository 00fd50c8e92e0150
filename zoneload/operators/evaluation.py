"""Evaluation of saved runs: pooled errors, outcomes by round, token usage, and fair pairing of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import all_known, cache_usage
from ..session import checkpoint


#: Groups whose means are broadcast: some 10 MB.
BROADCAST_GROUPS = 100_000


def pooled_errors(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled errors by group over finite rows, with their counts, totals and bias; zero actual loads are left out of
    MAPE only. RAE's denominator needs each group's mean first: means of up to ``BROADCAST_GROUPS`` groups are broadcast, of
    more they are repeated for 64 parts of each group, so that no task reads a group whole.

    Where the samples have them: ``q10_kwh`` and ``q90_kwh`` give the share of actual loads inside (rows with all three
    known); ``training_overlap`` and ``training_end`` (with ``origin``) the counts of what is known, and whether the
    group is out of sample: false if any row overlaps or has an origin before its training's end, else true if every
    row has both dates, else unknown. ``copies`` (removed ones of a row) are summed up.
    """
    a, p = F.col("actual_kwh"), F.col("predicted_kwh")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = samples.withColumn("fine", F.coalesce(finite(a) & finite(p), F.lit(False)))
    named = [F.col(k).alias(f"__{k}") for k in keys]
    means = checkpoint(rows.where("fine").groupBy(*named).agg(F.avg(a).alias("mean_actual")))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if not keys:
        both = rows.crossJoin(F.broadcast(means))
    elif means.count() <= BROADCAST_GROUPS:
        both = rows.join(F.broadcast(means), on, "left")
    else:
        parts = means.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(63))))
        both = rows.withColumn("__part", F.pmod(F.xxhash64(*samples.columns), F.lit(64)).cast("int")).join(parts, [*on, F.col("__part") == F.col("__of")], "left")
    valid = lambda c: F.when(F.col("fine"), c)
    error, size = valid(F.abs(a - p)), valid(F.abs(a))
    nonzero, spread = size > 1e-9, F.sum(valid(F.abs(a - F.col("mean_actual"))))
    total, guess = F.sum(valid(a)), F.sum(valid(p))
    extra = []
    if {"q10_kwh", "q90_kwh"} <= set(samples.columns):
        low, high = F.col("q10_kwh"), F.col("q90_kwh")
        known = finite(a) & finite(low) & finite(high)
        extra.append((F.avg(F.when(known, ((a >= low) & (a <= high)).cast("double"))) * 100).alias("interval_coverage_pct"))
    if {"training_overlap", "training_end", "origin"} <= set(samples.columns):
        overlap, dates = F.col("training_overlap"), F.col("origin").isNotNull() & F.col("training_end").isNotNull()
        inside = F.coalesce(overlap, F.lit(False)) | (dates & (F.col("origin") < F.col("training_end")))
        extra += [
            F.count_if(overlap).alias("training_overlap_count"), F.count(overlap).alias("training_known_count"), F.count_if(overlap.isNull()).alias("training_unknown_count"),
            F.when(F.bool_or(inside), False).when(F.bool_and(dates), True).alias("out_of_sample"),
        ]
    if "copies" in samples.columns:
        extra.append(F.sum("copies").alias("copies_removed"))
    return both.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if("fine").alias("n"), F.count_if(nonzero).alias("n_mape"), F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread > 1e-9, F.try_divide(F.sum(error), spread)).alias("rae"),
        (F.avg(F.when(nonzero, F.try_divide(error, size))) * 100).alias("mape_pct"), F.when(F.sum(size) > 1e-9, F.try_divide(F.sum(error), F.sum(size)) * 100).alias("wape_pct"),
        total.alias("actual_total_kwh"), guess.alias("predicted_total_kwh"), F.when(total != 0, F.try_divide(guess - total, total) * 100).alias("bias_pct"), *extra,
    )


def at_levels(rows: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Each row once for every level, with the level's name and its key (the values of its columns, joined by /), so that
    one grouping serves all levels."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entries = [F.struct(F.lit(level).alias("level"), F.concat_ws("/", *[text(c) for c in columns]).alias("key")) for level, columns in levels.items()]
    return rows.withColumn("__level", F.explode(F.array(*entries))).withColumns({"level": F.col("__level.level"), "key": F.col("__level.key")}).drop("__level")


def deduplicated(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each of the keys, and how many ``copies`` of it were removed. Of copies that differ elsewhere, one whole
    row stays: the least, whatever the partitioning."""
    rest = [c for c in samples.columns if c not in keys]
    kept = samples.groupBy(*keys).agg(*([F.min(F.struct(*rest)).alias("__row")] if rest else []), (F.count("*") - 1).alias("copies"))
    return kept.select(*keys, *[F.col("__row")[c].alias(c) for c in rest], "copies")


def conflicts(samples: DataFrame, identity: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Identities with more than one value; a null is a value of its own."""
    several = F.lit(False)
    counts = {}
    for v in values:
        counts[f"n_{v}"] = F.count_distinct(v) + F.max(F.col(v).isNull().cast("long"))
        several = several | (F.col(f"n_{v}") > 1)
    return samples.groupBy(*identity).agg(*[c.alias(n) for n, c in counts.items()]).where(several)


def round_grid(rows: DataFrame, keys: Sequence[str], limit: int, finals: DataFrame | None = None) -> DataFrame:
    """Rows of rounds 0 to ``limit`` for every window: recorded ones, and missing ones as unknown.

    ``finals`` (keys, status, attempts_used, attempt_limit, load_kwh, stress: a row per window that has a final one)
    carries the final window into later rounds where the run stopped early: status success, fewer rounds used than
    the limit.
    """
    grid = _grid(rows, keys, limit, finals)
    return grid.drop("__final")


def _grid(rows: DataFrame, keys: Sequence[str], limit: int, finals: DataFrame | None) -> DataFrame:
    """``round_grid`` with each window's final one as ``__final``. A window's rows, as many as rounds, are gathered in one
    grouping and laid out again, so nothing is joined; of rows dealt by some of the keys none moves."""
    values, state = [c for c in rows.columns if c not in keys and c != "round"], ["status", "attempts_used", "attempt_limit", "load_kwh", "stress"]
    given = rows.select(*keys, F.struct("round", *values).alias("__row"))
    if finals is not None:
        given = given.unionByName(finals.select(*keys, F.struct(*state).alias("__final")), allowMissingColumns=True)
    last = F.first("__final", True) if finals is not None else F.lit(None).cast("struct<status: string, attempts_used: bigint, attempt_limit: bigint, load_kwh: double, stress: string>")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    per = given.groupBy(*keys).agg(F.collect_list("__row").alias("__rows"), last.alias("__final")).withColumn("__final", F.when(known, F.col("__final")))
    cells = per.withColumn("__round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(limit).cast("long")))).withColumn("__known", known)
    out = cells.withColumn("__row", F.explode_outer(F.filter("__rows", lambda r: F.col("__known") & (r["round"] == F.col("__round")))))
    end, used = F.col("__final"), F.col("__final.attempts_used")
    early = (end["status"] == "success") & (used < end["attempt_limit"]) & (F.col("__round") > used)
    out = out.withColumn("__carried", F.col("__row").isNull() & F.coalesce(early, F.lit(False)))
    taken = [(F.when(F.col("__carried"), end[c]).otherwise(F.col("__row")[c]) if c in ("load_kwh", "stress") else F.col("__row")[c]).alias(c) for c in values]
    source = F.when(F.col("__carried"), "early_stop_carry").when(F.col("__row.load_kwh").isNull(), "missing").when(F.col("__round") == 0, "baseline").otherwise("attempt_trace")
    shown = out.select(*keys, *taken, F.col("__round").alias("round"), source.alias("source"), "__final")
    return shown.select(*keys, *values, "round", (F.col("stress") == "Medium").alias("medium"), "source", "__final")


def outcome_history(rows: DataFrame, keys: Sequence[str], limit: int, finals: DataFrame) -> DataFrame:
    """Rows of ``round_grid`` (phase baseline or round) and of ``final_rows`` (phase final) with ``history_fields`` and
    ``baseline_medium``, in one pass: a window's rounds up to its final one are a second track beside all rounds."""
    used, end = F.col("__final.attempts_used"), F.col("__final")
    tracks = F.array_compact(F.array(F.lit("rounds"), F.when(F.col("round") <= used, "final")))
    every = _grid(rows, keys, limit, finals).withColumn("__track", F.explode(tracks))
    ending = F.col("__track") == "final"
    last = ending & (F.col("round") == used) & (used > 0)
    every = every.withColumn("medium", F.when(last, end["stress"] == "Medium").otherwise(F.col("medium")))
    w = Window.partitionBy(*keys, "__track").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    known = history_fields(every, [*keys, "__track"]).withColumn("baseline_medium", F.first("medium").over(w)).where(~ending | (F.col("round") == used))
    final = {"load_kwh": end["load_kwh"], "stress": end["stress"], "medium": end["stress"] == "Medium", "source": F.lit("final_windows")}
    phase = F.when(ending, "final").when(F.col("round") == 0, "baseline").otherwise("round")
    return known.withColumns({**{n: F.when(ending, c).otherwise(F.col(n)) for n, c in final.items()}, "phase": phase}).drop("__final", "__track")


def final_rows(grid: DataFrame, keys: Sequence[str], finals: DataFrame) -> DataFrame:
    """The final row of each window, at the round its run ended with, with its history fields.

    Its history are the rounds before that one and the final state itself; a run without rounds has only the baseline.
    """
    used = F.col("attempts_used")
    ends = finals.select(*keys, "attempts_used", F.col("load_kwh").alias("__load"), F.col("stress").alias("__stress"))
    # Each window's rounds up to its last one, which gives its place to the final state.
    rows = grid.select(*keys, "round", "medium", "load_kwh", "stress").join(ends, list(keys)).where(F.col("round") <= used)
    last = (F.col("round") == used) & (used > 0)
    known = history_fields(rows.withColumn("medium", F.when(last, F.col("__stress") == "Medium").otherwise(F.col("medium"))), keys)
    return known.where(F.col("round") == used).withColumns({"load_kwh": F.col("__load"), "stress": F.col("__stress"), "medium": F.col("__stress") == "Medium", "source": F.lit("final_windows")}).drop("attempts_used", "__load", "__stress")


def history_fields(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By window and round: previous state, whether ever in the band, and the first entry, if it is known.

    Round 0 is the baseline. The first entry is unknown once an unknown round precedes it.
    """
    w = Window.partitionBy(*keys).orderBy("round")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    medium = F.col("medium")
    first_true = F.min(F.when(medium, F.col("round"))).over(upto)
    first_null = F.min(F.when(medium.isNull(), F.col("round"))).over(upto)
    baseline = F.first("medium").over(upto)
    clean = first_null.isNull() | (first_true < first_null)
    known = F.when(baseline.isNull(), False).when(baseline, True).otherwise(F.coalesce(clean, F.lit(False)))
    ever = F.when(first_true.isNotNull(), True).when(first_null.isNotNull(), F.lit(None)).otherwise(False)
    return rows.withColumns({
        "previous_medium": F.lag("medium").over(w), "first_entry_round": F.when(known, first_true), "first_entry_known": known, "ever_medium": ever,
        "ever_newly_medium": F.when(baseline, False).when(~baseline, ever),
    })


def transitions(rows: DataFrame, keys: Sequence[str], first: str, final: str) -> DataFrame:
    """First against final success, three-valued."""
    a, b = F.col(first), F.col(final)
    rate = lambda c: F.try_divide(F.count_if(c) * 100.0, F.count(c))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count(a).alias("first_known_count"), F.count(b).alias("final_known_count"), F.count_if(a).alias("first_success_count"), F.count_if(b).alias("final_success_count"),
        rate(a).alias("first_success_rate_pct"), rate(b).alias("final_success_rate_pct"), F.count_if(a & b).alias("retained_count"), F.count_if(~a & b).alias("gained_count"),
        F.count_if(a & ~b).alias("lost_count"), F.count_if(~a & ~b).alias("never_count"), F.count_if(a.isNull() | b.isNull()).alias("unknown_transition_count"),
    )


def all_success(rows: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[all_known(F.col(f)).alias(f) for f in flags])


TOKENS = ("prompt_tokens", "completion_tokens")


def agent_summary(runs: DataFrame, zones: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: transitions of runs, zones and windows (first_success, final_success), and means of attempts, calls and
    tokens per run, zone and call. Totals are pooled before means; a mean is unknown unless every row it needs is known.

    ``runs`` have attempts_used, agent_call_count, token counts and token_usage_complete, ``zones`` attempts_used.
    """
    parts = {}
    for scope, rows in (("run", runs), ("zone", zones), ("window", windows)):
        got = transitions(rows, keys, "first_success", "final_success")
        parts[scope] = got.withColumnsRenamed({c: f"{scope}_{c}" for c in got.columns if c not in keys})
    full = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    complete = F.bool_and(F.coalesce("token_usage_complete", F.lit(False)))
    of_runs = runs.groupBy(*keys).agg(
        full("attempts_used").alias("__attempts"), full("agent_call_count").alias("agent_call_count"), complete.alias("token_usage_complete"), F.count_if(~F.coalesce("token_usage_complete", F.lit(False))).alias("incomplete_usage_run_count"),
        *[F.sum(t).alias(f"known_{t}") for t in TOKENS],
    )
    of_zones = zones.groupBy(*keys).agg(full("attempts_used").alias("__zone_attempts"))
    out = parts["run"]
    for other in (parts["zone"], parts["window"], of_runs, of_zones):
        out = out.join(other, list(keys), "left")
    counts = {"run": "run_count", "zone": "zone_count", "call": "agent_call_count"}
    means = {"mean_attempts_per_run": F.try_divide("__attempts", "run_count"), "mean_attempts_per_zone": F.try_divide("__zone_attempts", "zone_count"), **{f"mean_calls_per_{s}": F.try_divide("agent_call_count", counts[s]) for s in ("run", "zone")}}
    for t in TOKENS:
        whole = F.when(F.col("token_usage_complete"), F.col(f"known_{t}"))
        means |= {t: whole, **{f"mean_{t}_per_{s}": F.try_divide(whole, c) for s, c in counts.items()}}
    return out.withColumns(means).drop("__attempts", "__zone_attempts")


def usage_columns(calls: DataFrame) -> DataFrame:
    """Calls with ``complete`` and the normalised cache fields."""
    complete = F.coalesce(F.col("token_usage_complete"), F.lit(True))
    for t in TOKENS:
        complete = complete & F.col(t).isNotNull()
    cache = cache_usage(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("token_usage_complete"))
    return calls.select("*", complete.alias("complete"), *[c.alias(f"u_{n}") for n, c in cache.items()])


def usage_summary(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, totals and distributions of calls by group: totals are null unless every row is complete.

    Percentiles are of equal values' counts, so a group's rows are never gathered.
    """
    rows = usage_columns(calls)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.bool_and("complete").alias("token_usage_complete"), F.count_if(~F.col("complete")).alias("incomplete_rows"),
        *[f(t).alias(f"{n}_{t}") for t in TOKENS for n, f in (("known", F.sum), ("mean", F.avg))],
    )
    long = rows.select(*keys, *TOKENS).unpivot(list(keys), list(TOKENS), "__token", "__value").where("__value IS NOT NULL")
    counts = long.groupBy(*keys, "__token", "__value").agg(F.count("*").alias("__n"))
    middle = counts.groupBy(*keys).agg(*[F.percentile(F.when(F.col("__token") == t, F.col("__value")), [0.5, 0.95], F.col("__n")).alias(t) for t in TOKENS])
    named = middle.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(t).alias(f"__{t}") for t in TOKENS])
    out = sums.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    whole = lambda c: F.when(F.col("token_usage_complete"), c)
    shown = [*keys, "calls", "token_usage_complete", "incomplete_rows"]
    for t in TOKENS:
        half, high = F.col(f"__{t}")[0], F.col(f"__{t}")[1]
        shown += [whole(F.col(f"known_{t}")).alias(t), f"known_{t}", whole(F.col(f"mean_{t}")).alias(f"mean_{t}"), whole(half).alias(f"median_{t}"), whole(high).alias(f"p95_{t}"), high.alias(f"known_p95_{t}")]
    return out.select(*shown)


def call_tables(calls: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """``usage_summary`` over several groupings of calls in one pass, with the runs of each group and their mean tokens."""
    rows = at_levels(calls, levels)
    runs = rows.select("level", "key", "run").distinct().groupBy("level", "key").agg(F.count("*").alias("run_count"))
    got = usage_summary(rows, ["level", "key"]).join(runs, ["level", "key"])
    return got.withColumns({f"mean_{t}_per_run": F.try_divide(t, "run_count") for t in TOKENS})


def round_tables(calls: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Totals of rounds (a run's calls of one attempt) over several groupings in one pass: rounds, runs, calls, tokens
    (null unless every round is complete), known tokens, mean tokens per run. Levels' columns belong to the run or attempt."""
    names = list(dict.fromkeys(["run", "attempt", *[c for cs in levels.values() for c in cs]]))
    sums = [F.sum(t).alias(f"known_{t}") for t in TOKENS]
    rounds = usage_columns(calls).groupBy(*names).agg(F.count("*").alias("calls"), F.bool_and("complete").alias("complete"), *sums)
    rows = at_levels(rounds, levels)
    runs = rows.select("level", "key", "run").distinct().groupBy("level", "key").agg(F.count("*").alias("run_count"))
    got = rows.groupBy("level", "key").agg(
        F.count("*").alias("rounds"), F.sum("calls").alias("agent_call_count"), F.bool_and("complete").alias("token_usage_complete"), F.count_if(~F.col("complete")).alias("incomplete_rounds"),
        *[F.sum(f"known_{t}").alias(f"known_{t}") for t in TOKENS],
    ).join(runs, ["level", "key"])
    whole = {t: F.when(F.col("token_usage_complete"), F.col(f"known_{t}")) for t in TOKENS}
    return got.withColumns(whole).withColumns({f"mean_{t}_per_run": F.try_divide(t, "run_count") for t in TOKENS})


def cache_summary(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    ok = F.bool_and("u_cache_usage_complete")
    return usage_columns(calls).groupBy(*keys).agg(
        F.when(ok, F.sum("u_cached_tokens")).alias("cached_tokens"), F.sum("u_known_cached_tokens").alias("known_cached_tokens"), F.sum("u_cache_reported_call_count").alias("cache_reported_call_count"),
        ok.alias("cache_usage_complete"), F.when(ok & (F.sum("prompt_tokens") > 0), F.try_divide(F.sum("u_cached_tokens"), F.sum("prompt_tokens"))).alias("cache_hit_ratio"),
    )


def round_usage(calls: DataFrame) -> DataFrame:
    """By run and attempt: calls, known tokens, completeness, agents invoked; and the running totals of the run."""
    got = usage_columns(calls).groupBy("run", "attempt").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("known_prompt_tokens"), F.bool_and("complete").alias("complete"), F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"))
    w = Window.partitionBy("run").orderBy("attempt")
    return got.withColumns({"cumulative_calls": F.sum("calls").over(w), "cumulative_prompt_tokens": F.sum("known_prompt_tokens").over(w), "cumulative_complete": F.bool_and("complete").over(w)})


def usage_audit(calls: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per run: counted calls and tokens against recorded ones: match, partial (something unknown) or mismatch."""
    counted = usage_columns(calls).groupBy("run").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("tokens"), F.bool_and("complete").alias("complete"))
    both = counted.join(recorded, "run", "full_outer")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    unknown = F.col("calls").isNull() | F.col("recorded_calls").isNull() | F.col("tokens").isNull() | F.col("recorded_tokens").isNull() | ~F.coalesce("complete", F.lit(False))
    fields = F.array_compact(F.array(F.when(differs("calls", "recorded_calls"), "calls"), F.when(differs("tokens", "recorded_tokens"), "tokens")))
    return both.select("run", F.when(F.size(fields) > 0, "mismatch").when(unknown, "partial").otherwise("match").alias("status"), F.array_join(fields, ",").alias("fields"))


def mode_cohorts(runs: DataFrame, identity: str = "identity") -> DataFrame:
    """batch, identity, status and reason: accepted if every mode of the batch has one run, of one known signature."""
    # Kept once, as the batches' modes come from it too; more than one signature shows in the least and the largest.
    got = checkpoint(runs.groupBy("batch", identity).agg(F.collect_set("mode").alias("own"), F.count("*").alias("n"), (F.min("signature") != F.max("signature")).alias("differ"), F.count_if(F.col("signature").isNull()).alias("unknown")))
    modes = got.select("batch", F.explode("own").alias("mode")).distinct().groupBy("batch").agg(F.count("*").alias("modes"))
    got = got.withColumn("have", F.size("own"))
    reason = (
        F.when(F.col("n") > F.col("have"), "duplicate_mode").when(F.col("have") < F.col("modes"), "missing_mode")
        .when(F.col("unknown") > 0, "unknown_signature").when(F.col("differ"), "inconsistent_signature")
    )
    # A batch without any known mode has none.
    return got.where("batch IS NOT NULL").join(modes, "batch", "left").fillna({"modes": 0}).select("batch", identity, reason.isNull().alias("accepted"), reason.alias("reason"))


def batch_pairs(runs: DataFrame) -> DataFrame:
    """left_batch, right_batch, identity, mode, status of the pair's runs.

    An identity and mode meets the pairs that one of its own batches is part of: its batches are gathered (at most as
    many as there are batches) and combined with the others, so nothing is paired that has no run on either side.
    """
    batches = runs.select("batch").distinct()
    one = runs.groupBy("batch", "identity", "mode").agg(F.count("*").alias("n"), F.max("signature").alias("s"), F.min("signature").isNull().alias("u"))
    every = batches.agg(F.sort_array(F.collect_set("batch")).alias("batches"))
    cells = one.groupBy("identity", "mode").agg(F.map_from_entries(F.collect_list(F.struct("batch", F.struct("n", "s", "u")))).alias("runs"))
    mine = cells.join(every).withColumn("left_batch", F.explode("batches")).withColumn("right_batch", F.explode(F.filter("batches", lambda b: b > F.col("left_batch"))))
    left, right = F.try_element_at("runs", F.col("left_batch")), F.try_element_at("runs", F.col("right_batch"))
    met = mine.withColumns({"l": left, "r": right}).where("l IS NOT NULL OR r IS NOT NULL")
    status = (
        F.when(F.col("l").isNull() | F.col("r").isNull(), "missing").when((F.col("l.n") > 1) | (F.col("r.n") > 1), "ambiguous")
        .when(F.col("l.u") | F.col("r.u"), "unknown").when(F.col("l.s") != F.col("r.s"), "inconsistent").otherwise("matched")
    )
    return met.select("left_batch", "right_batch", "identity", "mode", status.alias("status"))


def paired_summary(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched pairs by batches and mode: successes and tokens left and right, and their differences if known."""
    side = lambda name: runs.select(F.col("batch").alias(f"{name}_batch"), "identity", "mode", F.col("final_success").alias(f"{name}_ok"), F.col("tokens").alias(f"{name}_tokens"))
    rows = pairs.where("status = 'matched'").join(side("left"), ["left_batch", "identity", "mode"]).join(side("right"), ["right_batch", "identity", "mode"])
    full = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(F.col(c).cast("long")))
    got = rows.groupBy("left_batch", "right_batch", "mode").agg(F.count("*").alias("pairs"), *[full(f"{s}_{v}").alias(f"{s}_{v}") for s in ("left", "right") for v in ("ok", "tokens")])
    return got.withColumns({f"delta_{v}": F.col(f"right_{v}") - F.col(f"left_{v}") for v in ("ok", "tokens")})


def signatures(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A content hash per group that doesn't depend on the rows' order.

    Rows are dealt to 256 parts of their group by their own hash and hashed there, sorted; the group's hash is that of
    its parts' hashes. So no task gathers a group whole.
    """
    row = F.sha2(F.to_json(F.struct(*fields)), 256)
    dealt = rows.select(*keys, row.alias("__row")).withColumn("__part", F.substring("__row", 1, 2))
    parts = dealt.groupBy(*keys, "__part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("__row")), "\n"), 256).alias("__hash"), F.count("*").alias("__n"))
    listed = F.sort_array(F.collect_list(F.struct("__part", "__hash")))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda p: p["__hash"]), "\n"), 256).alias("signature"), F.sum("__n").alias("rows"))


def expected_windows(observed: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with how they differ: missing, extra or duplicate."""
    o = observed.groupBy(*key).agg(F.count("*").alias("n"))
    both = o.join(expected.select(*key, F.lit(True).alias("e")).distinct(), list(key), "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return both.select(*key, status.alias("status")).where("status IS NOT NULL")


def round_matrix(rows: DataFrame, usage: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    """Per group one column set per round: windows in the band, newly in it, unknown, first entries, and mean tokens per run.

    ``rows``: windows by round (0: baseline) with history fields and baseline_medium; ``usage``: keys, run, round, tokens
    (null unless complete). Tokens of a round are known only where every run of the group has that round's.
    """
    numbers = list(range(rounds + 1))
    flat = rows.withColumn("enters", F.col("first_entry_known") & (F.col("first_entry_round") == F.col("round")))
    seen = flat.groupBy(*keys).pivot("round", numbers).agg(
        F.count_if("medium").alias("medium"), F.count_if(~F.col("baseline_medium") & F.col("medium")).alias("new"), F.count_if(F.col("medium").isNull()).alias("unknown"), F.count_if("enters").alias("entered")
    )
    runs = rows.select(*keys, "run").distinct().groupBy(*keys).agg(F.count("*").alias("run_count"))
    per = usage.groupBy(*keys, "round").agg(F.count("tokens").alias("known"), F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.sum("tokens").alias("tokens")).join(runs, list(keys))
    mean = F.when((F.col("known") == F.col("n")) & (F.col("runs") == F.col("run_count")), F.col("tokens") / F.col("run_count"))
    spent = per.withColumn("mean", mean).groupBy(*keys).pivot("round", numbers[1:]).agg(F.max("mean").alias("mean"))
    spent = spent.withColumnsRenamed({str(n): f"mean_tokens_{n}" for n in numbers[1:]})
    return seen.join(runs, list(keys)).join(spent, list(keys), "left")


def price_comparison(rows: DataFrame, keys: Sequence[str], within_pct: float = 8.0) -> DataFrame:
    """Per group of rows with both prices (baseline_price, predicted_price): windows, those whose difference is within the
    share of the baseline, accuracy and means. A baseline of 0 is met only by 0, and has no relative difference."""
    base, guess = F.col("baseline_price"), F.col("predicted_price")
    near = F.abs(guess - base) <= F.abs(base) * (within_pct / 100)
    return rows.where(base.isNotNull() & guess.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if(near).alias("within_pct"), (F.count_if(near) * 100.0 / F.count("*")).alias("accuracy_pct"), F.avg(guess).alias("mean_predicted"), F.avg(base).alias("mean_baseline"),
        F.avg(guess - base).alias("mean_difference"), F.avg(F.when(base != 0, (guess - base) / base * 100)).alias("mean_difference_pct"),
    )


def control_summary(windows: DataFrame) -> DataFrame:
    """Per run of window rows (run, zone, round, medium, source): status (success if every zone succeeds, unknown if none
    fails but some isn't known), zones, how many succeed and fail, and the last attempt."""
    zones = windows.where("round > 0").groupBy("run", "zone").agg(all_known(F.col("medium")).alias("ok"), F.max(F.when(F.col("source") != "missing", F.col("round"))).alias("last"))
    got = zones.groupBy("run").agg(all_known(F.col("ok")).alias("s"), F.count("*").alias("zones"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.max("last").alias("max_attempts"))
    return got.select("run", F.when(F.col("s"), "success").when(F.col("s").isNull(), "unknown").otherwise("fail").alias("status"), "zones", "succeeded", "failed", "max_attempts")

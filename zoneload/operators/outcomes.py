"""Outcomes of windows by round, zone and run, over several sets of dimensions in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bands, and what stands for none.
STRESS = ("Low", "Medium", "High", "Extremely High", "Unknown")
#: Counts that add up from any grain to any coarser one.
COUNTS = (
    "window_count medium_known_count medium_count baseline_medium_count baseline_medium_known_count baseline_comparable_count new_medium_count lost_medium_count "
    "adjacent_comparable_count gained_medium_count exited_medium_count first_entry_count first_entry_unknown_count never_entered_medium_count ever_newly_medium_count "
    "ever_newly_medium_unknown_count ever_medium_final_exit_count ever_newly_medium_final_exit_count control_success_count control_success_known_count"
).split()
LEVELS = ("zone", "run")


def with_expected(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows with the number of different windows of their zone, and of their run, in any round."""
    windows = rows.select("run", "zone", *identity).distinct()
    of_zone = windows.groupBy("run", "zone").agg(F.count("*").alias("zone_expected_window_count"))
    of_run = of_zone.groupBy("run").agg(F.sum("zone_expected_window_count").alias("run_expected_window_count"))
    return rows.join(of_zone, ["run", "zone"]).join(of_run, "run")


def _counts() -> dict[str, Column]:
    m, b, p, ever, newly = (F.col(c) for c in ("medium", "baseline_medium", "previous_medium", "ever_medium", "ever_newly_medium"))
    known, first, last = F.coalesce("first_entry_known", F.lit(False)), F.col("first_entry_round"), F.col("phase") == "final"
    entered = ~b & known
    tests = [
        F.lit(True), m.isNotNull(), m, b, b.isNotNull(), b.isNotNull() & m.isNotNull(), ~b & m, b & ~m, p.isNotNull() & m.isNotNull(), ~p & m, p & ~m, entered & (first == F.col("round")), ~known,
        entered & first.isNull(), newly, newly.isNull(), last & ever & ~m, last & newly & ~m, F.col("control_success"), F.col("control_success").isNotNull(),
    ]
    out = dict(zip(COUNTS, map(F.count_if, tests), strict=True))
    stress = F.coalesce("stress", F.lit("Unknown"))
    return out | {f"__s{i}": F.count_if(stress == name) for i, name in enumerate(STRESS)}


def _entries(rounds: int) -> dict[str, Column]:
    entered = ~F.col("baseline_medium") & F.col("first_entry_known")
    return {f"__e{n}": F.count_if(entered & (F.col("first_entry_round") == n)) for n in range(rounds + 1)}


def _complete(level: str) -> dict[str, Column]:
    """A grain's row as one zone or run: complete if it has all its windows and knows each one's state."""
    whole = (F.col("__windows") >= F.coalesce(f"__{level}_expected", F.lit(0))) & F.col("__known")
    return {f"{level}_count": F.lit(1), f"{level}_complete_count": whole.cast("int"), f"{level}_unknown_count": (~whole).cast("int"), f"{level}_all_medium_count": (whole & F.col("__all")).cast("int")}


def _tables(grain: DataFrame, sets: dict[str, Sequence[str]], summed: Sequence[str]) -> DataFrame:
    """The sums over several sets of columns, with each set's name as ``level``."""
    names = sorted({k for s in sets.values() for k in s})
    level = F.lit(None).cast("string")
    for name, s in sets.items():
        there = F.lit(True)
        for k in names:
            there = there & (F.grouping(k) == (0 if k in s else 1))
        level = F.when(there, name).otherwise(level)
    return grain.groupingSets([[F.col(k) for k in s] for s in sets.values()], *names).agg(level.alias("level"), *[F.sum(c).alias(c) for c in summed])


def window_outcomes(rows: DataFrame, sets: dict[str, Sequence[str]], rounds: int, identity: Sequence[str] = ("window",)) -> DataFrame:
    """``level`` (a set's name), the sets' columns (null where a set lacks one), phase, round and all measures.

    ``rows``: one per batch, run, zone, window (``identity``), phase and round, with the sets' columns, the history fields,
    control_success, stress, zone_expected_window_count and run_expected_window_count. Unknown is never a failure: rates
    are of what is known. A zone, or run, is complete in a group if it has as many different windows there as expected and
    each one's state is known. ``rounds``: the largest round, for the distribution of first entries.

    The rows are grouped once, by zone and round; runs are sums of zones, and every set's groups are sums of runs (of
    zones, if the set has the zone), so that all but the first step works on few rows.
    """
    finest = list(dict.fromkeys([*[k for s in sets.values() for k in s], "batch", "run", "zone", "phase", "round"]))
    counts = _counts() | _entries(rounds)
    m = F.col("medium")
    zones = rows.groupBy(*finest).agg(
        *[c.alias(n) for n, c in counts.items()], F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]).alias("__windows"), F.max("zone_expected_window_count").alias("__zone_expected"),
        F.max("run_expected_window_count").alias("__run_expected"), (F.count(m) == F.count("*")).alias("__known"), F.bool_and(F.coalesce(m, F.lit(False))).alias("__all"),
    ).withColumns(_complete("zone"))
    of_zone = list(_complete("zone"))
    whole = [k for k in finest if k != "zone"]
    runs = zones.groupBy(*whole).agg(*[F.sum(c).alias(c) for c in [*counts, *of_zone, "__windows"]], F.max("__run_expected").alias("__run_expected"), F.bool_and("__known").alias("__known"), F.bool_and("__all").alias("__all"))
    summed, parts = [*counts, *of_zone, *_complete("run")], []
    for grain, chosen in ((runs, {n: s for n, s in sets.items() if "zone" not in s}), (zones, {n: s for n, s in sets.items() if "zone" in s})):
        if chosen:
            parts.append(_tables(grain.withColumns(_complete("run")), {n: [*s, "phase", "round"] for n, s in chosen.items()}, summed))
    got = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return _shown(got, list(dict.fromkeys(k for s in sets.values() for k in s)), rounds)


def _map(names: Sequence[str], columns: Sequence[str]) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*columns)), lambda _, n: n > 0)


def _shown(got: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    n, c = F.col("window_count"), F.col
    share = lambda part, of: F.try_divide(c(part) * 100.0, c(of))
    more = {
        "medium_unknown_count": n - c("medium_known_count"), "medium_coverage_pct": share("medium_known_count", "window_count"), "medium_rate_pct": share("medium_count", "medium_known_count"),
        "baseline_medium_unknown_count": n - c("baseline_medium_known_count"), "baseline_unknown_transition_count": n - c("baseline_comparable_count"), "net_medium_count": c("new_medium_count") - c("lost_medium_count"),
        "adjacent_unknown_transition_count": n - c("adjacent_comparable_count"), "adjacent_net_medium_count": c("gained_medium_count") - c("exited_medium_count"), "control_success_unknown_count": n - c("control_success_known_count"),
        "first_entry_round_distribution": _map([str(i) for i in range(rounds + 1)], [f"__e{i}" for i in range(rounds + 1)]), "stress_distribution": _map(STRESS, [f"__s{i}" for i in range(len(STRESS))]),
    }
    levels = [f"{level}_{kind}_count".replace("__", "_") for level in LEVELS for kind in ("", "complete", "unknown", "all_medium")]
    return got.select("level", *keys, "phase", "round", *COUNTS, *levels, *[v.alias(k) for k, v in more.items()])

"""What makes two saved runs comparable: whole windows, known thresholds, covered hours, and hashes of their content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRESS = ("Low", "Medium", "High", "Extremely High")
#: Sums of halves of two 64-bit hashes of a row.
LANES = 4


def _lanes(row: Column) -> list[Column]:
    halves = lambda h: [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return [half for seed in range(LANES // 2) for half in halves(F.xxhash64(F.lit(seed), row))]


def _row(*names: str) -> Column:
    """Columns as one to hash, each with whether it's null, as hashes pass over nulls."""
    return F.struct(*[c for n in names for c in (F.col(n).isNull().alias(f"__no_{n}"), F.col(n))])


def content_sums(row: Column) -> list[Column]:
    """Aggregates of a set of rows (one column of any type but a map) that don't depend on their order: sums of the parts of
    each row's hashes, 128 bits in all. They merge in partial aggregation, so no task gathers a group; equal sums mean equal
    rows, as each row counts as often as it occurs (by chance; they are no guard against rows made to collide)."""
    return [F.sum(lane).alias(f"__sum{i}") for i, lane in enumerate(_lanes(row))]


def content_signature(sums: str = "__sum") -> Column:
    """The digest of a group's ``content_sums``."""
    return F.sha2(F.concat_ws("-", *[F.col(f"{sums}{i}").cast("string") for i in range(LANES)]), 256)


def _finite(value: Column) -> Column:
    return F.coalesce((value >= 0) & (value < float("inf")) & ~F.isnan(value), F.lit(False))


def _key(*columns: str) -> list[str]:
    return ["run", "zone_id", *columns]


def window_evidence(windows: DataFrame, expected: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per run: zones, ``whole`` and the content sums of their windows and thresholds.

    ``windows``: the final ones (run, zone_id, window_start, window_end, mean_energy_price, sum_predicted_kwh,
    load_stress_level); ``expected``: run, zone_id, window_start, window_end; ``thresholds``: run, zone_id,
    low_medium_kwh, medium_high_kwh. A run is whole if every zone has thresholds and exactly the expected windows,
    each once, with finite values and a known band.
    """
    at, level, bands = _key("window_start", "window_end"), F.col("load_stress_level"), F.array(*map(F.lit, STRESS))
    fine = _finite(F.col("mean_energy_price")) & _finite(F.col("sum_predicted_kwh")) & F.coalesce(level.isin(*STRESS), F.lit(False))
    # Bands stand as numbers, which hash aggregates hold.
    seen = windows.select(*at, F.lit(False).alias("wanted"), fine.alias("fine"), "mean_energy_price", "sum_predicted_kwh", F.array_position(bands, level).cast("int").alias("band"))
    both = seen.unionByName(expected.select(*at, F.lit(True).alias("wanted")), allowMissingColumns=True).groupBy(*at).agg(
        (F.count_if(~F.col("wanted")) == 1).alias("once"), F.bool_and("fine").alias("fine"), F.bool_or("wanted").alias("wanted"), *[F.max(c).alias(c) for c in ("mean_energy_price", "sum_predicted_kwh", "band")]
    )
    whole = F.coalesce(F.col("once") & F.col("fine") & F.col("wanted") & (F.col("window_start") <= F.col("window_end")), F.lit(False))
    row = _row("zone_id", "window_start", "window_end", "mean_energy_price", "sum_predicted_kwh", "band")
    of_windows = both.groupBy("run", "zone_id").agg(F.lit(True).alias("there"), F.bool_and(whole).alias("whole"), *content_sums(row))
    low, high = F.col("low_medium_kwh"), F.col("medium_high_kwh")
    bounds = thresholds.groupBy("run", "zone_id").agg(F.bool_and(_finite(low) & _finite(high)).alias("bounded"), F.max(F.struct(low, high)).alias("t"))
    bounds = bounds.select("run", "zone_id", "bounded", "t.*")
    zones = of_windows.unionByName(bounds.select("run", "zone_id", "bounded", *[lane.alias(f"__sum{i}") for i, lane in enumerate(_lanes(_row("zone_id", "low_medium_kwh", "medium_high_kwh")))]), allowMissingColumns=True).groupBy("run", "zone_id").agg(
        F.bool_or("there").alias("there"), (F.bool_and("whole") & F.coalesce(F.bool_and("bounded"), F.lit(False))).alias("whole"), *[F.sum(f"__sum{i}").alias(f"__sum{i}") for i in range(LANES)]
    )
    return zones.where("there").groupBy("run").agg(F.count("*").alias("zones"), F.bool_and("whole").alias("whole"), *[F.sum(f"__sum{i}").alias(f"__sum{i}") for i in range(LANES)])


def hourly_evidence(hourly: DataFrame, expected: DataFrame) -> DataFrame:
    """Per run: ``covered``, whether every hour of the expected windows has one row with finite ``actual_kwh`` and
    ``predicted_kwh`` and there is no other hour; and ``apart``, whether no hour is in two expected windows."""
    windows = expected.where("window_start <= window_end").select(*_key("window_start", "window_end")).distinct()
    hours = windows.select("run", "zone_id", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 hour"))).alias("time"), F.lit(0).alias("n"), F.lit(1).alias("wanted"))
    number = lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    seen = hourly.select(*_key("time"), F.lit(1).alias("n"), F.lit(0).alias("wanted"), (number(F.col("actual_kwh")) & number(F.col("predicted_kwh"))).alias("fine"))
    cells = seen.unionByName(hours, allowMissingColumns=True).groupBy(*_key("time")).agg(F.sum("n").alias("n"), F.sum("wanted").alias("wanted"), F.bool_and("fine").alias("fine"))
    covered = F.coalesce((F.col("n") == 1) & F.col("fine") & (F.col("wanted") > 0), F.lit(False))
    return cells.groupBy("run").agg(F.bool_and(covered).alias("covered"), F.bool_and(F.col("wanted") <= 1).alias("apart"))


def pairing_evidence(windows: DataFrame, expected: DataFrame, thresholds: DataFrame, hourly: DataFrame, parameters: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Per run: zones, complete, baseline_signature, hourly_signature, parameters_signature and ``pairing_ready``: complete
    windows, covered hours and known parameters (run, parameters map). Runs without any window aren't ready.

    A run is complete if its windows are whole and no hour is in two expected ones. ``fields`` of ``hourly`` (saved prices and
    their validity) go into its signature. Each step groups by the run and more, and tables meet in unions: of tables
    dealt by run, no row moves again.
    """
    known = F.coalesce(F.size("parameters") > 0, F.lit(False))
    entries = F.to_json(F.array_sort(F.map_entries("parameters")))
    of_run = parameters.select("run", F.when(known, F.sha2(entries, 256)).alias("parameters_signature"))
    # Where hours are covered each has one row, so their sums are those of all rows.
    content = hourly.groupBy("run").agg(*content_sums(_row("zone_id", "time", "actual_kwh", "predicted_kwh", *fields)))
    parts = window_evidence(windows, expected, thresholds), hourly_evidence(hourly, expected), content.withColumnsRenamed({f"__sum{i}": f"__hour{i}" for i in range(LANES)})
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    found = every.groupBy("run").agg(*[F.max(c).alias(c) for c in every.columns if c != "run"])
    complete, covered = F.coalesce(F.col("whole") & F.col("apart"), F.lit(False)), F.col("covered")
    hours = content_signature("__hour")
    got = of_run.join(found, "run", "left").select(
        "run", F.coalesce("zones", F.lit(0)).alias("zones"), complete.alias("complete"), F.when(complete, content_signature()).alias("baseline_signature"), F.when(covered, hours).alias("hourly_signature"), "parameters_signature"
    )
    ready = F.col("complete") & F.col("hourly_signature").isNotNull() & F.col("parameters_signature").isNotNull()
    return got.withColumn("pairing_ready", ready)

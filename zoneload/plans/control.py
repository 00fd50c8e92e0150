"""Price proposals per window, their re-forecast, checks, and a bounded control loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, pricing
from ..operators import features as A
from ..operators import prepare as P
from ..session import checkpoint

KEY = ["zone_id", "origin", "window"]
ROUNDS = 3


def proposals(windows: DataFrame, category: Column) -> DataFrame:
    """Windows with sensitivity, suggested shift, label, proposed price and its validity."""
    sensitivity = pricing.elasticity(category, F.col("mean_occupancy"), F.col("total_rain"))
    rows = windows.withColumn("elasticity", sensitivity)
    shift = pricing.shift_to_medium(F.col("sum_predicted_kwh"), F.col("low_kwh"), F.col("high_kwh"), F.col("elasticity"), F.lit(0.0))
    rows = rows.withColumn("shift", F.round(shift + 1e-9, 2))
    final = pricing.finalized(F.col("mean_energy_price"), F.col("shift"), F.lit(None).cast("double"))
    return rows.withColumns({**final, "action_label": pricing.action_label(F.col("shift"))}).drop("shift")


def assessed(windows: DataFrame, stress: str = "reforecast_load_stress_level") -> DataFrame:
    """control_success and the reason of a failure: an invalid price, no forecast, or another band than Medium."""
    valid, level = F.coalesce("price_valid", F.lit(False)), F.col(stress)
    reason = (
        F.when(~valid, "invalid_non_negative_energy_price_constraint")
        .when(level.isNull(), "price_conditioned_forecast_unavailable")
        .when(level != bands.MEDIUM, F.concat(F.lit("price_conditioned_load_is_"), level))
    )
    return windows.withColumns({"control_success": valid & F.coalesce(level == bands.MEDIUM, F.lit(False)), "control_failure_reason": reason})


def zone_status(windows: DataFrame, keys: list[str]) -> DataFrame:
    return windows.groupBy(*keys).agg(F.when(F.bool_and("control_success"), "success").otherwise("fail").alias("control_status"), F.count_if(~F.col("control_success")).alias("failed_window_count"))


def reforecast(windows: DataFrame, hourly: DataFrame, response: DataFrame, reference: DataFrame) -> DataFrame:
    """Windows with the load, position and band of a forecast under the proposed prices.

    ``hourly``: KEY, timestamp, base_kwh, energy_price of the forecast that made the windows. Only the price effect
    is made anew; each window's hours take its price.
    """
    from .forecast import FLOOR, MAX_RATIO

    priced = windows.select(*KEY, F.when(F.col("price_valid"), F.col("proposed_energy_price")).alias("proposed"))
    rows = hourly.join(priced, KEY).withColumn("price", F.coalesce("proposed", "energy_price")).withColumn("hour", F.hour("timestamp"))
    rows = rows.join(response, ["zone_id", "origin"], "left").join(reference.select("zone_id", "origin", "hour", "hour_price"), ["zone_id", "origin", "hour"], "left")
    limit = F.greatest(F.col("base_kwh") * MAX_RATIO, F.greatest(F.col("mean_load") * FLOOR, F.lit(1e-9)))
    moved = F.coalesce(F.greatest(-limit, F.least(limit, F.col("slope") * (F.col("price") - F.coalesce("hour_price", "mean_price")))), F.lit(0.0))
    load = rows.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0.0), F.col("base_kwh") + moved)).alias("reforecast_load_kwh"))
    out = windows.join(load, KEY, "left")
    place = bands.range_position(F.col("reforecast_load_kwh"), F.col("low_kwh"), F.col("high_kwh"))
    return out.withColumns({
        "reforecast_load_range_position_pct": F.when(F.col("reforecast_load_kwh").isNotNull(), place),
        "reforecast_load_stress_level": F.when(F.col("reforecast_load_kwh").isNotNull(), bands.classify(place)),
        "reforecast_source": F.when(F.col("reforecast_load_kwh").isNull(), "missing_price_conditioned_forecast_window").otherwise("reforecast_with_proposed_energy_price"),
    })


def merged_revision(previous: DataFrame, revised: DataFrame) -> DataFrame:
    """Failed windows take the revised price fields; the others keep theirs. ``proposal_status`` tells which."""
    fields = ["suggested_price_shift_pct", "proposed_energy_price", "price_valid", "action_label"]
    new = revised.select(*KEY, *[F.col(f).alias(f"__{f}") for f in fields])
    takes = ~F.col("control_success") & F.col("__proposed_energy_price").isNotNull()
    rows = previous.join(new, KEY, "left")
    return rows.withColumns({**{f: F.when(takes, F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}, "proposal_status": F.when(takes, "revised").otherwise("frozen")}).drop(*[f"__{f}" for f in fields])


def attempt_changes(trace: DataFrame) -> DataFrame:
    """Per window and attempt: the price before (the baseline's at first), and what changed since."""
    w = Window.partitionBy(*KEY).orderBy("attempt")
    first = F.col("attempt") == 1
    before = F.when(first, F.col("mean_energy_price")).otherwise(F.lag("proposed_energy_price").over(w))
    shift = F.when(first, 0.0).otherwise(F.lag("suggested_price_shift_pct").over(w))
    rows = trace.withColumns({"previous_energy_price": before, "previous_shift_pct": shift, "trigger_reason": F.lag("control_failure_reason").over(w)})
    amount = F.col("proposed_energy_price") - F.col("previous_energy_price")
    return rows.withColumns({
        "price_change_amount": amount,
        "price_change_pct": F.when(F.col("previous_energy_price") > 0, F.try_divide(amount, "previous_energy_price") * 100),
        "shift_change_pct": F.col("suggested_price_shift_pct") - F.col("previous_shift_pct"),
        "price_changed": F.abs(amount) > 1e-9,
    })


#: What a failed attempt leaves for the proposals after it.
_CONTEXT = "array<struct<attempt: int, proposed_energy_price: double, suggested_price_shift_pct: double, reforecast_load_kwh: double, reforecast_load_stress_level: string, control_failure_reason: string>>"


def retry_context(failed: DataFrame) -> Column:
    """A failed window's earlier failures with this one after them."""
    return F.concat("retry_context", F.array(F.struct("attempt", "proposed_energy_price", "suggested_price_shift_pct", "reforecast_load_kwh", "reforecast_load_stress_level", "control_failure_reason")).cast(_CONTEXT))


def control_loop(windows: DataFrame, hourly: DataFrame, response: DataFrame, reference: DataFrame, category: Column, rounds: int = ROUNDS) -> DataFrame:
    """The trace of at most ``rounds`` attempts: propose, re-forecast, check, revise what failed.

    ``retry_context`` of a row are the failures that its proposal was made from, in order: the load of the last of them takes
    the place of the window's load. Windows that succeeded leave the loop: later attempts repeat their rows as frozen,
    and only failed ones are forecast again. The inputs are kept once, as every attempt reads them, and every attempt's
    result, so plans don't grow; the loop ends early once nothing fails.
    """
    windows, hourly, response, reference = (checkpoint(t) for t in (windows, hourly, response, reference))
    current = proposals(windows, category).withColumns({"proposal_status": F.lit("initial"), "retry_context": F.array().cast(_CONTEXT)})
    trace = settled = None
    for attempt in range(1, rounds + 1):
        result = assessed(reforecast(current, hourly, response, reference)).withColumn("attempt", F.lit(attempt))
        if settled is not None:
            result = result.unionByName(settled.withColumns({"attempt": F.lit(attempt), "proposal_status": F.lit("frozen")}))
        result = checkpoint(result)
        trace = result if trace is None else trace.unionByName(result)
        failed, settled = result.where("NOT control_success"), result.where("control_success")
        if attempt == rounds or failed.isEmpty():
            break
        made = ["reforecast_load_kwh", "reforecast_load_range_position_pct", "reforecast_load_stress_level", "reforecast_source"]
        known = failed.withColumn("retry_context", retry_context(failed))
        again = known.withColumn("sum_predicted_kwh", F.coalesce(F.element_at("retry_context", -1)["reforecast_load_kwh"], "sum_predicted_kwh")).drop("elasticity", "suggested_price_shift_pct", "proposed_energy_price", "price_valid", "action_label")
        current = merged_revision(known, proposals(again, category)).drop(*made, "control_success", "control_failure_reason", "attempt")
    return trace


def zone_briefs(windows: DataFrame, category: Column) -> DataFrame:
    """Per zone and origin: whether anything needs a change, stressed windows, the peak, and a base shift by worst band."""
    keys = ["zone_id", "origin"]
    high = F.col("load_stress_level").isin(bands.HIGH, bands.EXTREME)
    peak = F.max(F.struct("sum_predicted_kwh", (-F.col("window")).alias("w"), "window_start"))
    got = windows.groupBy(*keys).agg(
        F.bool_or(F.col("load_stress_level") != bands.MEDIUM).alias("adjustment_needed"), F.count_if(high).alias("high_windows"), peak["window_start"].alias("peak_start"), F.sum("total_rain").alias("rain"),
    ).join(A.zone_stress(windows, keys).select(*keys, F.col("load_stress_level").alias("worst")), keys)
    worst = F.col("worst")
    shift = F.when(worst == bands.EXTREME, 15).when(worst == bands.HIGH, 8).when(worst == bands.LOW, -8).otherwise(0)
    label = (
        F.when((worst == bands.EXTREME) & (category == "Residential"), "Raise energy price for peak deflection").when(worst == bands.EXTREME, "Raise energy price for congestion")
        .when(worst == bands.HIGH, "Raise energy price for high load").when(worst == bands.LOW, "Reduce energy price for utilization").otherwise("Hold energy price")
    )
    drivers = F.array_compact(F.array(F.when(F.col("high_windows") > 0, F.concat(F.col("high_windows").cast("string"), F.lit(" high-stress 3-hour windows"))), F.concat(F.lit("peak window "), F.date_format("peak_start", "yyyy-MM-dd HH:mm")), F.when(F.col("rain") > 0, "rain")))
    return got.withColumns({"base_shift_pct": shift, "base_label": label, "drivers": F.array_join(drivers, "; ")})


def proposal_errors(expected: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: what is wrong with a proposed list (position, window_start, shift, price) for an expected one."""
    e = expected.select(*keys, "position", F.col("window_start").alias("e_start"))
    p = proposed.select(*keys, "position", F.col("window_start").alias("p_start"), "shift", "price", F.lit(True).alias("there"))
    at = F.concat(F.lit("windows["), F.col("position").cast("string"), F.lit("] "))
    found = F.array_compact(F.array(
        F.when(F.col("there").isNull(), F.concat(at, F.lit("missing"))), F.when(F.col("there") & F.col("shift").isNull(), F.concat(at, F.lit("invalid shift"))),
        F.when(F.col("there") & F.col("price").isNull(), F.concat(at, F.lit("invalid price"))), F.when(F.col("p_start") != F.col("e_start"), F.concat(at, F.lit("window_start does not match"))),
    ))
    rows = e.join(p, [*keys, "position"], "left").withColumn("errors", found)
    return rows.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "errors"))), lambda x: x["errors"])).alias("errors"))


def normalized_windows(expected: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Identity from the forecast, price fields from the proposal by position; a marker where there is none."""
    p = proposed.select(*keys, "position", "shift", "price", "label")
    rows = expected.join(p, [*keys, "position"], "left")
    return rows.withColumn("label", F.coalesce("label", F.lit("MODEL_RESPONSE_FAILED")))


def complete_cached(expected: DataFrame, cached: DataFrame) -> DataFrame:
    """Per zone: expected and usable cached windows, and whether all are there."""
    usable = cached.where("sum_predicted_kwh IS NOT NULL AND energy_price > 0").select("zone_id", "window_start", F.lit(True).alias("ok")).distinct()
    got = expected.join(usable, ["zone_id", "window_start"], "left").groupBy("zone_id").agg(F.count("*").alias("expected"), F.count_if("ok").alias("usable"))
    return got.withColumn("complete", F.col("expected") == F.col("usable"))


def applied_cache(windows: DataFrame, cached: DataFrame, fields: list[str]) -> DataFrame:
    """Windows whose fields are overwritten where the cache has a value; the shift follows from both prices."""
    new = cached.select("zone_id", "window_start", *[F.col(f).alias(f"__{f}") for f in fields])
    rows = windows.join(new, ["zone_id", "window_start"], "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])
    return rows.withColumn("shift_pct", F.when(F.col("base_price") != 0, (F.try_divide("energy_price", "base_price") - 1) * 100))

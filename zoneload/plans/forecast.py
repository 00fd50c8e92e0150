"""Load forecasts of all zones and origins at once.

Origins are midnights. Histories meet origins by day, in an equi-join with each origin's days; what belongs to several
origins is summed up by hour right after that join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blend
from ..operators.features import segments

KEY = ["zone_id", "origin"]
#: Weights of the weekly lag and the hour's mean, bounds of the trend, and of price effects.
LAG_WEIGHT, MEAN_WEIGHT = 0.72, 0.28
TREND = (0.75, 1.25)
ELASTICITY, MAX_RATIO, LEAST_ROWS, FLOOR = 0.1, 0.3, 12, 0.05


def at_origins(series: DataFrame, origins: DataFrame, first_day: int, end_day: int) -> DataFrame:
    """Rows from ``first_day`` to before ``end_day`` days relative to each origin."""
    first = F.col("origin").cast("date")
    days = origins.select("origin", F.explode(F.sequence(F.date_add(first, first_day), F.date_add(first, end_day - 1))).alias("__day"))
    return series.withColumn("__day", F.col("timestamp").cast("date")).join(days, "__day").drop("__day")


def hourly_means(history: DataFrame) -> DataFrame:
    return history.groupBy(*KEY, F.hour("timestamp").alias("hour")).agg(F.avg("load_kwh").alias("hour_load"), F.avg("energy_price").alias("hour_price"))


def price_response(history: DataFrame) -> DataFrame:
    """Per zone and origin: slope of load on price within hours of the day, bounded; and mean load and price."""
    load, price = F.col("load_kwh"), F.col("energy_price")
    known = history.where(load.isNotNull() & price.isNotNull()).withColumn("hour", F.hour("timestamp"))
    cells = known.groupBy(*KEY, "hour").agg(
        F.count("*").alias("n"), F.avg(price).alias("p"), F.covar_pop(load, price).alias("cov"), F.var_pop(price).alias("var"),
        F.sum(F.greatest(load, F.lit(0.0))).alias("l0"), F.sum(F.nullif(price, F.lit(0.0))).alias("p0"), F.count(F.nullif(price, F.lit(0.0))).alias("n0"), F.min(price).alias("low"), F.max(price).alias("high"),
    )
    total = cells.groupBy(*KEY).agg(
        F.sum("n").alias("rows"), (F.sum("l0") / F.sum("n")).alias("load"), F.try_divide(F.sum("p0"), F.sum("n0")).alias("price"),
        F.sum(F.col("n") * F.col("cov")).alias("cov"), F.sum(F.col("n") * F.col("var")).alias("var"),
        F.collect_list(F.struct("n", "p", "var")).alias("hours"), (F.min("low") < F.max("high")).alias("varies"),  # 24 hours at most
    )
    base = F.try_divide("load", "price")
    flat = F.col("var") <= 1e-12 * F.col("rows")
    # Where price never varies within an hour, its distance to the overall mean takes the residual's place.
    apart = F.aggregate("hours", F.lit(0.0), lambda done, h: done + h["n"] * (h["var"] + (h["p"] - F.col("price")) * (h["p"] - F.col("price"))))
    var = F.when(flat, apart).otherwise(F.col("var"))
    empirical = F.when((F.col("rows") >= LEAST_ROWS) & F.col("varies") & (var > 1e-12), F.try_divide("cov", var))
    slope = F.when(empirical < 0, empirical).otherwise(-ELASTICITY * base)
    usable = total.where((F.col("load") > 0) & (F.col("price") > 0))
    return usable.select(*KEY, F.round(F.greatest(-MAX_RATIO * base, F.least(F.lit(0.0), slope)), 6).alias("slope"), F.round(F.col("load") + 1e-9, 4).alias("mean_load"), F.round(F.col("price") + 1e-9, 6).alias("mean_price"))


def ar_forecast(series: DataFrame, origins: DataFrame, history_days: int, horizon_days: int = 1, response: DataFrame | None = None, reference: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Hourly forecasts: KEY, timestamp, hour, energy_price, base_kwh, adjustment_kwh, raw_kwh.

    Weekly lag and the hour's mean, scaled by the last day against the mean day, then moved by how far the price
    is from the frozen history's price of that hour. ``prices`` (zone_id, timestamp, energy_price) may replace the
    horizon's; ``response`` and ``reference`` may come from an earlier, frozen history.
    """
    history = at_origins(series, origins, -history_days, 0)
    means = hourly_means(history)
    recent = F.col("timestamp") >= F.expr("origin - interval 1 day")
    trend = history.groupBy(*KEY).agg(F.sum(F.when(recent, F.col("load_kwh"))).alias("last"), (F.sum("load_kwh") / F.count_distinct(F.col("timestamp").cast("date"))).alias("daily"))
    scale = F.when(F.coalesce("daily", F.lit(0.0)) == 0, 1.0).otherwise(F.greatest(F.lit(TREND[0]), F.least(F.lit(TREND[1]), F.try_divide("last", "daily"))))
    trend = trend.select(*KEY, scale.alias("scale"))
    response = price_response(history) if response is None else response
    reference = means if reference is None else reference
    future = at_origins(series.drop("load_kwh"), origins, 0, horizon_days).withColumn("hour", F.hour("timestamp"))
    if prices is not None:
        future = future.drop("energy_price").join(prices, ["zone_id", "timestamp"], "left")
    week = history.select(*KEY, (F.col("timestamp") + F.expr("interval 7 days")).alias("timestamp"), F.col("load_kwh").alias("lag_week"))
    week = week.where((F.col("timestamp") >= F.col("origin")) & (F.col("timestamp") < F.col("origin") + F.make_dt_interval(days=F.lit(horizon_days))))
    rows = (
        future.join(week, [*KEY, "timestamp"], "left")
        .join(means.select(*KEY, "hour", "hour_load"), [*KEY, "hour"], "left")
        .join(reference.select(*KEY, "hour", F.col("hour_price").alias("reference")), [*KEY, "hour"], "left")
        .join(trend, KEY, "left")
        .join(response, KEY, "left")
    )
    plain = F.when(F.col("lag_week").isNull(), F.col("hour_load")).otherwise(LAG_WEIGHT * F.col("lag_week") + MEAN_WEIGHT * F.col("hour_load"))
    base = F.greatest(F.lit(0.0), plain * F.col("scale"))
    limit = F.greatest(F.col("base_kwh") * MAX_RATIO, F.greatest(F.col("mean_load") * FLOOR, F.lit(1e-9)))
    shift = F.col("slope") * (F.coalesce("energy_price", "mean_price") - F.coalesce("reference", "mean_price"))
    adjustment = F.coalesce(F.greatest(-limit, F.least(limit, shift)), F.lit(0.0))
    rows = rows.withColumn("base_kwh", base).withColumn("adjustment_kwh", adjustment)
    return rows.withColumn("raw_kwh", F.greatest(F.lit(0.0), F.col("base_kwh") + F.col("adjustment_kwh"))).drop("lag_week", "hour_load", "reference", "scale", "slope", "mean_load", "mean_price")


def forecast_matrix(series: DataFrame, origins: DataFrame, history_days: int, alphas: Sequence[float]) -> DataFrame:
    """Forecasts for all blends at once: the raw forecast is computed once and shared."""
    raw = ar_forecast(series, origins, history_days)
    diurnal = hourly_means(at_origins(series, origins, -history_days, 0)).select(*KEY, "hour", F.col("hour_load").alias("diurnal"))
    grid = raw.join(diurnal, [*KEY, "hour"], "left").withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return grid.withColumn("predicted_kwh", blend(F.col("raw_kwh"), F.coalesce("diurnal", "raw_kwh"), F.col("alpha"))).drop("diurnal")


def zone_summaries(matrix: DataFrame, series: DataFrame, origins: DataFrame) -> DataFrame:
    """Per zone, origin and blend: total, peak, and change against the day before."""
    before = at_origins(series, origins, -1, 0).groupBy(*KEY).agg(F.sum("load_kwh").alias("previous"))
    got = matrix.groupBy(*KEY, "alpha").agg(F.sum("predicted_kwh").alias("forecast_total_kwh"), F.max("predicted_kwh").alias("forecast_peak_kwh"), F.count("*").alias("hours"))
    change = F.coalesce(F.try_divide(F.col("forecast_total_kwh") - F.col("previous"), "previous") * 100, F.lit(0.0))
    return got.join(before, KEY, "left").withColumn("predicted_change_pct", change).drop("previous")


def calibrated_forecast(series: DataFrame, origins: DataFrame, history_days: int, calibration_days: int, alpha: float) -> DataFrame:
    """Forecasts corrected by the mean error of each hour over the days before, with the errors' 90 % half width.

    Price response, price reference and diurnal curve come from the first history, before the calibration days;
    each calibration day is forecast from the days right before it.
    """
    frozen = at_origins(series, origins, -history_days - calibration_days, -calibration_days)
    response, cells = price_response(frozen), hourly_means(frozen)
    days = origins.select(F.col("origin").alias("final"), F.explode(F.array(*[F.lit(i) for i in range(calibration_days + 1)])).alias("back"))
    shifted = days.withColumn("origin", (F.col("final") - F.make_dt_interval(days=F.col("back"))).cast("timestamp_ntz"))
    key = ["zone_id", "final", "back"]

    # The same forecast with origins moved back; (final, back) keeps them apart where they coincide.
    every = shifted.select("origin").distinct()
    history = at_origins(series, every, -history_days, 0)
    means = hourly_means(history)
    raw = ar_forecast(series, every, history_days, response=history.select(*KEY).distinct().select(*KEY, F.lit(0.0).alias("slope"), F.lit(0.0).alias("mean_load"), F.lit(0.0).alias("mean_price")), reference=means)
    base = raw.select(*KEY, "timestamp", "hour", "energy_price", "base_kwh").join(shifted, "origin")
    of_final = lambda t: t.withColumnRenamed("origin", "final")
    rows = base.join(of_final(response), ["zone_id", "final"], "left").join(of_final(cells), ["zone_id", "final", "hour"], "left")
    limit = F.greatest(F.col("base_kwh") * MAX_RATIO, F.greatest(F.col("mean_load") * FLOOR, F.lit(1e-9)))
    moved = F.coalesce(F.greatest(-limit, F.least(limit, F.col("slope") * (F.col("energy_price") - F.coalesce("hour_price", "mean_price")))), F.lit(0.0))
    rows = rows.withColumn("raw_kwh", F.greatest(F.lit(0.0), F.col("base_kwh") + moved))
    rows = rows.withColumn("blended_kwh", blend(F.col("raw_kwh"), F.col("hour_load"), F.lit(alpha))).select(*key, "timestamp", "hour", "raw_kwh", "blended_kwh")
    past = rows.where("back > 0").join(series.select("zone_id", "timestamp", "load_kwh"), ["zone_id", "timestamp"]).withColumn("residual", F.col("blended_kwh") - F.col("load_kwh"))
    bias = past.groupBy("zone_id", "final", "hour").agg(F.avg("residual").alias("bias"))
    width = past.join(bias, ["zone_id", "final", "hour"]).groupBy("zone_id", "final").agg(F.percentile(F.abs(F.col("residual") - F.col("bias")), 0.9).alias("half_width"))
    out = rows.where("back = 0").join(bias, ["zone_id", "final", "hour"]).join(width, ["zone_id", "final"])
    corrected = F.greatest(F.lit(0.0), F.col("blended_kwh") - F.col("bias"))
    return out.select("zone_id", F.col("final").alias("origin"), "timestamp", "raw_kwh", "blended_kwh", "bias", corrected.alias("predicted_kwh"), "half_width")


def daily_backtest(series: DataFrame, origins: DataFrame, history_days: int) -> DataFrame:
    """One row: days forecast, hours and pooled errors over all complete days of the range."""
    raw = ar_forecast(series, origins, history_days)
    both = raw.join(series.select("zone_id", "timestamp", "load_kwh"), ["zone_id", "timestamp"]).where("load_kwh IS NOT NULL AND raw_kwh IS NOT NULL")
    whole = Window.partitionBy(*KEY)
    complete = both.withColumn("n", F.count("*").over(whole)).where("n = 24")
    error = F.abs(F.col("load_kwh") - F.col("raw_kwh"))
    return complete.agg(F.count_distinct("origin").alias("days"), F.count("*").alias("hours"), F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (F.sum(error) / F.sum(F.abs("load_kwh")) * 100).alias("wape_pct"))


def custom_predictor(history: DataFrame, future: DataFrame, predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A user's ``predict(context, future)`` for each zone and origin; times and finiteness are checked."""

    def run(context: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        ahead = ahead.sort_values("timestamp").reset_index(drop=True)
        if not len(ahead):
            return ahead[["zone_id", "origin", "timestamp"]].assign(predicted_kwh=pd.Series(dtype=float))
        got = predict(context.sort_values("timestamp").reset_index(drop=True), ahead)
        if list(got["timestamp"]) != list(ahead["timestamp"]) or not np.isfinite(got["predicted_kwh"].to_numpy(float)).all():
            raise ValueError("a predictor must return a finite value for every hour asked")
        return ahead[["zone_id", "origin", "timestamp"]].assign(predicted_kwh=got["predicted_kwh"].to_numpy(float))

    schema = "zone_id string, origin timestamp_ntz, timestamp timestamp_ntz, predicted_kwh double"
    return history.groupBy(*KEY).cogroup(future.groupBy(*KEY)).applyInPandas(run, schema)


def supervised_windows(series: DataFrame, past: int, ahead: int, covariates: Sequence[str], stride: int = 24, train_end: Column | None = None) -> DataFrame:
    """Samples of complete windows within continuous hours, every ``stride``-th of each segment, by window functions.

    history and targets (arrays of loads), means and deviations of the last 24 and 168 hours (``past`` at most), and by
    hour ahead the covariates (NaN where missing), their missing flags and the calendar. With ``train_end`` loads are
    normalised by each zone's mean and deviation of the hours before it, which are given too; a zone without such
    hours has no sample. Hours without a finite load are gaps.
    """
    load = F.col("load_kwh").cast("double")
    rows = segments(series.where(load.isNotNull() & ~F.isnan(load) & (F.abs(load) < float("inf"))))
    zone, w = Window.partitionBy("zone_id"), Window.partitionBy("zone_id", "segment").orderBy("timestamp")
    back, fore = w.rowsBetween(-past, -1), w.rowsBetween(0, ahead - 1)
    scale = {}
    if train_end is not None:
        prefix = F.when(F.col("timestamp") < train_end, load)
        deviation = F.stddev_pop(prefix).over(zone)
        scale = {"load_mean": F.avg(prefix).over(zone), "load_std": F.when(deviation <= 1e-8, 1.0).otherwise(deviation)}
        rows = rows.withColumns(scale)
        load = (load - F.col("load_mean")) / F.col("load_std")
    hour, day = F.hour("timestamp") * (2 * np.pi / 24), F.weekday("timestamp") * (2 * np.pi / 7)
    ahead_of = {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "weekday_sin": F.sin(day), "weekday_cos": F.cos(day)}
    for c in covariates:
        x = F.col(c).cast("double")
        fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        ahead_of |= {c: F.when(fine, x).otherwise(float("nan")), f"{c}_missing": F.when(fine, 0.0).otherwise(1.0)}
    one = lambda c: F.collect_list(c.cast("float"))
    rows = rows.withColumn("load", load)
    stats = {}
    for n in dict.fromkeys([min(24, past), min(168, past)]):
        stats |= {f"load_mean_{n}": F.avg("load").over(w.rowsBetween(-n, -1)), f"load_std_{n}": F.stddev_pop("load").over(w.rowsBetween(-n, -1))}
    rows = rows.withColumns({"history": one(F.col("load")).over(back), "targets": one(F.col("load")).over(fore), **stats, **{f"future_{n}": one(c).over(fore) for n, c in ahead_of.items()}, "at": F.row_number().over(w)})
    whole = (F.size("history") == past) & (F.size("targets") == ahead) & ((F.col("at") - past - 1) % stride == 0)
    return rows.where(whole).select("zone_id", "timestamp", "history", "targets", *stats, *[f"future_{n}" for n in ahead_of], *scale)

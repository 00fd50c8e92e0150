"""Zone features, load policies, price references, windows over hours, and zone selection."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.scalars import safe_divide
from ..session import checkpoint
from .quantiles import quantiles, quantiles_of_counts


def day_parts(hour: Column) -> dict[str, Column]:
    """Parts of the day; night and evening overlap."""
    return {"morning": hour.between(7, 10), "noon": hour.between(11, 14), "evening": hour.between(17, 22), "night": (hour >= 20) | (hour <= 6)}


def load_features(series: DataFrame) -> DataFrame:
    """Per zone: mean, peak, variation, p99 over mean, shares by part of the day, weekend over weekday."""
    load, mean = F.col("load_kwh"), F.col("mean_load_kwh")
    weekend, spans = F.weekday("timestamp") >= 5, day_parts(F.hour("timestamp"))
    got = series.groupBy("zone_id").agg(
        F.avg(load).alias("mean_load_kwh"), F.max(load).alias("peak_load_kwh"), F.stddev_samp(load).alias("sd"), F.percentile(load, 0.99).alias("p99"),
        *[F.avg(F.when(span, load)).alias(name) for name, span in spans.items()], F.avg(F.when(weekend, load)).alias("we"), F.avg(F.when(~weekend, load)).alias("wd"),
    )
    return got.select(
        "zone_id", F.coalesce(mean, F.lit(0.0)).alias("mean_load_kwh"), F.coalesce("peak_load_kwh", F.lit(0.0)).alias("peak_load_kwh"), safe_divide(F.col("sd"), mean).alias("load_cv"), safe_divide(F.col("p99"), mean).alias("burstiness_p99_mean"),
        *[safe_divide(F.col(name), mean).alias(f"{name}_ratio") for name in spans], safe_divide(F.col("we"), F.col("wd")).alias("weekend_ratio"),
    )


def price_features(series: DataFrame, column: str, kind: str, bounds: bool = False) -> DataFrame:
    """Per zone: mean and deviation (and bounds) of a price; 0 counts as unknown."""
    price = F.nullif(F.col(column), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    extra = [zero(F.min(price)).alias(f"historical_min_{kind}_price"), zero(F.max(price)).alias(f"historical_max_{kind}_price")] if bounds else []
    return series.groupBy("zone_id").agg(zero(F.avg(price)).alias(f"mean_{kind}_price"), zero(F.stddev_samp(price)).alias(f"{kind}_price_std"), *extra)


def station_profile(stations: DataFrame) -> DataFrame:
    """Per zone: stations, centroid, chargers, area and perimeter of the first station, capacity."""
    return stations.groupBy("zone_id").agg(
        F.count("*").alias("station_count"), F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude"), F.sum("charge_count").alias("charge_count"),
        F.min_by("area", "station_id").alias("area"), F.min_by("perimeter", "station_id").alias("perimeter"), (F.sum("charge_count") * 11.0).alias("capacity_kw_proxy"),
    )


def slot_start(time: str = "timestamp", hours: int = 3) -> Column:
    """The start of the clock-aligned slot of some hours."""
    return (F.date_trunc("day", time) + F.make_dt_interval(hours=F.floor(F.hour(time) / hours).cast("int") * hours)).cast("timestamp_ntz")


def load_policy(series: DataFrame, origin: Column) -> DataFrame:
    """Per zone, from slots of three hours before ``origin``: bounds, range and threshold loads."""
    slots = series.where(F.col("timestamp") < origin).groupBy("zone_id", slot_start().alias("slot")).agg(F.sum(F.col("load_kwh").cast("decimal(18,2)")).cast("double").alias("load"))
    low, high = F.col("low_kwh"), F.col("high_kwh")
    got = slots.where("load IS NOT NULL").groupBy("zone_id").agg(F.count("*").alias("windows"), F.min("load").alias("low_kwh"), F.max("load").alias("high_kwh"))
    return got.withColumns({"range_kwh": high - low, "low_medium_kwh": bands.threshold(low, high, bands.LOW_END), "medium_high_kwh": bands.threshold(low, high, bands.MEDIUM_END), "high_extreme_kwh": bands.threshold(low, high, bands.HIGH_END)})


def price_changes(series: DataFrame) -> DataFrame:
    """zone_id, slot, change_pct: the mean price of each slot of three hours against the slot before it."""
    slots = series.groupBy("zone_id", slot_start().alias("slot")).agg(F.avg("energy_price").alias("price"))
    before = slots.select("zone_id", (F.col("slot") + F.expr("interval 3 hours")).alias("slot"), F.col("price").alias("previous"))
    return slots.join(before, ["zone_id", "slot"]).where("previous > 0").select("zone_id", "slot", (F.abs(F.try_divide(F.col("price") - F.col("previous"), "previous")) * 100).alias("change_pct"))


def price_reference(changes: DataFrame) -> DataFrame:
    """One row: p95 (to 8 places), observations, how many aren't 0."""
    counts = checkpoint(changes.where("change_pct IS NOT NULL").groupBy(F.col("change_pct").alias("value")).agg(F.count("*").alias("n")).withColumn("name", F.lit("change")))
    totals = counts.agg(F.lit("change").alias("name"), F.sum("n").alias("observations"), F.coalesce(F.sum(F.when(F.col("value") > 0, F.col("n"))), F.lit(0)).alias("nonzero_observations"))
    return totals.join(quantiles_of_counts(counts, [0.95]), "name", "left").select(F.round("value", 8).alias("p95_pct"), "observations", "nonzero_observations")


def percentile_of(values: DataFrame, value: str, reference: DataFrame) -> DataFrame:
    """``values`` with the share of reference changes that aren't larger (percent), and whether it is above p95.

    Distinct reference values (to 8 places) and the asked ones are merged in one order; a running count of the reference
    gives each its share. The reference is kept once, for the shares and for p95.
    """
    kept = checkpoint(reference.select("change_pct"))
    steps = kept.groupBy(F.round("change_pct", 8).alias("v")).count()
    summary = price_reference(kept).first()
    asked = values.select(F.abs(value).alias("v")).distinct().where("v IS NOT NULL")
    grid = steps.select("v", "count", F.lit(0).alias("asked")).unionByName(asked.select("v", F.lit(0).cast("long").alias("count"), F.lit(1).alias("asked")))
    total = F.lit(summary["observations"] or 0)
    shares = running_total(grid, "v", "count", "upto").where("asked = 1").select("v", F.round(F.try_divide(F.col("upto") * 100.0, total), 4).alias("percentile"))
    return values.join(shares, F.abs(value) == F.col("v"), "left").drop("v").withColumn("exceeds_p95", F.abs(value) > summary["p95_pct"])


def running_total(rows: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows up to their own ``order``, equal ones included.

    Rows are partitioned by ranges of ``order``; sums of whole partitions (a row each) come before those within, so no
    task sees all rows.
    """
    dealt = checkpoint(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    offsets = sums.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    local = F.sum(amount).over(Window.partitionBy("__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__local", local).join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def even_origins(series: DataFrame, count: int, history_days: int, horizon_days: int) -> DataFrame:
    """pick (from 1), origin: ``count`` midnights, evenly spaced within those for which every zone has every hour of the
    days before and of the horizon. No rows if there are fewer such midnights than asked for."""
    hours = series.groupBy("zone_id", F.col("timestamp").cast("date").alias("day")).agg(F.count_distinct("timestamp").alias("n"))
    zones = series.select("zone_id").distinct().count()
    days = hours.groupBy("day").agg((F.count_if(F.col("n") == 24) == zones).alias("whole"))
    first, last = F.date_sub("day", horizon_days - 1), F.date_add("day", history_days)
    reached = days.where("whole").select(F.explode(F.sequence(first, last)).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    fine = reached.where(F.col("n") == history_days + horizon_days).select(F.col("day").cast("timestamp_ntz").alias("origin"))
    order = Window.orderBy("origin")  # a row per day
    ranked = fine.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy())}).where(F.col("n") >= count)
    picks = F.filter(F.sequence(F.lit(1), F.lit(count)), lambda k: F.col("at") == F.floor(k * F.col("n") / (count + 1)))
    return ranked.select(F.explode(picks).alias("pick"), "origin").withColumn("pick", F.col("pick").cast("long"))


def lags(series: DataFrame, column: str, steps: Sequence[int]) -> DataFrame:
    w = Window.partitionBy("zone_id").orderBy("timestamp")
    return series.withColumns({f"lag_{n}": F.lag(column, n).over(w) for n in steps})


def rolling(series: DataFrame, column: str, sizes: Sequence[int]) -> DataFrame:
    """Mean and population deviation of the rows before; null while there are fewer."""
    out = {}
    for n in sizes:
        w = Window.partitionBy("zone_id").orderBy("timestamp").rowsBetween(-n, -1)
        full = F.count(column).over(w) == n
        out[f"mean_{n}"], out[f"std_{n}"] = F.when(full, F.avg(column).over(w)), F.when(full, F.stddev_pop(column).over(w))
    return series.withColumns(out)


def segments(series: DataFrame) -> DataFrame:
    """Rows with the number of their unbroken run of hours, by zone."""
    w = Window.partitionBy("zone_id").orderBy("timestamp")
    new = F.coalesce(F.col("timestamp") != F.lag("timestamp").over(w) + F.expr("interval 1 hour"), F.lit(True))
    return series.withColumn("__new", new.cast("int")).withColumn("segment", F.sum("__new").over(w)).drop("__new")


def segment_intervals(series: DataFrame) -> DataFrame:
    return segments(series).groupBy("zone_id", "segment").agg(F.min("timestamp").alias("start"), (F.max("timestamp") + F.expr("interval 1 hour")).alias("end"), F.count("*").alias("hours"))


def complete_targets(series: DataFrame, past: int, ahead: int, stride: int) -> DataFrame:
    """Hours with ``past`` hours before and ``ahead`` from them on in one segment, every ``stride``-th."""
    w = Window.partitionBy("zone_id", "segment")
    rows = segments(series).withColumns({"at": F.row_number().over(w.orderBy("timestamp")) - 1, "size": F.count("*").over(w)})
    return rows.where((F.col("at") >= past) & (F.col("at") + ahead <= F.col("size")) & ((F.col("at") - past) % stride == 0)).select("zone_id", "timestamp", "segment")


def train_split(targets: DataFrame, ratio: float, ahead: int) -> DataFrame:
    """Targets as train, validation or purged: a training label may not reach into validation."""
    w = Window.partitionBy("zone_id")
    n = F.count("*").over(w)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(ratio))))
    rows = targets.withColumns({"at": F.row_number().over(w.orderBy("timestamp")) - 1, "cut": cut})
    first = F.min(F.when(F.col("at") >= F.col("cut"), F.col("timestamp"))).over(w)
    role = F.when(F.col("at") >= F.col("cut"), "validation").when(F.coalesce(F.col("timestamp") + F.expr(f"interval {ahead} hours") <= first, F.lit(True)), "train").otherwise("purged")
    return rows.withColumn("role", role).select("zone_id", "timestamp", "role")


def filled(series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gaps take the value before, else the one after, else the zone's mean, else 0."""
    w = Window.partitionBy("zone_id")
    back, ahead = w.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0), w.orderBy("timestamp").rowsBetween(0, Window.unboundedFollowing)
    return series.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.avg(c).over(w), F.lit(0.0)) for c in columns})


def latest(series: DataFrame, n: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("zone_id").orderBy(F.desc("timestamp")))
    return series.withColumn("__n", number).where(F.col("__n") <= n).drop("__n")


def missing_hours(series: DataFrame, grid: DataFrame) -> DataFrame:
    """zone_id, timestamp of hours in ``grid`` (timestamp) that a zone lacks."""
    return series.select("zone_id").distinct().crossJoin(F.broadcast(grid)).join(series.select("zone_id", "timestamp"), ["zone_id", "timestamp"], "left_anti")


def diurnal_profile(history: DataFrame) -> DataFrame:
    """zone_id, hour, load: mean by hour of day, the overall mean where an hour is missing."""
    means = history.groupBy("zone_id", F.hour("timestamp").alias("hour")).agg(F.avg("load_kwh").alias("m"), F.sum("load_kwh").alias("s"), F.count("load_kwh").alias("n"))
    whole = means.groupBy("zone_id").agg((F.sum("s") / F.sum("n")).alias("mean"))
    grid = whole.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(means, ["zone_id", "hour"], "left").select("zone_id", "hour", F.coalesce("m", "mean").alias("diurnal_kwh"))


def hourly_shape(history: DataFrame) -> DataFrame:
    """Per zone: by part of the day, the mean of its hours' means."""
    hours = history.groupBy("zone_id", F.hour("timestamp").alias("h")).agg(F.avg("load_kwh").alias("m"))
    names = {"morning": "morning_7_10", "noon": "noon_11_14", "evening": "evening_17_22", "night": "night_20_6"}
    return hours.groupBy("zone_id").agg(*[F.coalesce(F.avg(F.when(p, F.col("m"))), F.lit(0.0)).alias(names[n]) for n, p in day_parts(F.col("h")).items()])


def pricing_windows(hourly: DataFrame, keys: Sequence[str], policy: DataFrame | None = None, hours: int = 3) -> DataFrame:
    """Every ``hours`` consecutive rows per ``keys``: loads, mean prices and weather, rain; with a policy, the band."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")) - 1
    chunks = hourly.withColumn("window", F.floor(number / hours))
    means = {"service_price": "mean_service_price", "energy_price": "mean_energy_price", "occupancy": "mean_occupancy", "temperature": "mean_temp_c", "humidity": "mean_humidity"}
    aggs = [F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"), F.count("*").alias("hours")]
    for kind in ("predicted", "actual"):
        if f"{kind}_kwh" in hourly.columns:
            aggs += [f(f"{kind}_kwh").alias(f"{name}_{kind}_kwh") for name, f in (("mean", F.avg), ("sum", F.sum), ("peak", F.max))]
    aggs += [F.avg(c).alias(n) for c, n in means.items() if c in hourly.columns]
    if "rain" in hourly.columns:
        aggs.append(F.sum("rain").alias("total_rain"))
    out = chunks.groupBy(*keys, "window").agg(*aggs)
    if policy is None:
        return out
    bound = policy.select("zone_id", *[k for k in keys if k != "zone_id" and k in policy.columns], "low_kwh", "high_kwh")
    out = out.join(bound, [k for k in keys if k in bound.columns], "left")
    place = bands.range_position(F.col("sum_predicted_kwh"), F.col("low_kwh"), F.col("high_kwh"))
    out = out.withColumns({"load_range_position_pct": place, "load_stress_level": bands.classify(place)})
    if "sum_actual_kwh" in out.columns:
        actual = F.when(F.col("sum_actual_kwh").isNotNull(), bands.classify(bands.range_position(F.col("sum_actual_kwh"), F.col("low_kwh"), F.col("high_kwh"))))
        out = out.withColumn("actual_load_stress_level", actual)
        p, a = bands.rank(F.col("load_stress_level")), bands.rank(F.col("actual_load_stress_level"))
        out = out.withColumns({"stress_correct": p == a, "stress_missed": a > p})
    return out


def zone_stress(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst band, largest window load and position."""
    worst = F.max(F.struct(bands.rank(F.col("load_stress_level")).alias("r"), F.col("load_stress_level").alias("l")))
    return windows.groupBy(*keys).agg(worst["l"].alias("load_stress_level"), F.max("sum_predicted_kwh").alias("stress_load_kwh"), F.max("load_range_position_pct").alias("max_position_pct"))


#: Weights of the winsorised features in each category's score.
CATEGORY_WEIGHTS = {
    "CBD / Office": {"poi_business_density": 1.2, "morning_ratio": 0.9, "noon_ratio": 0.7, "mean_load_kwh": 0.15, "night_ratio": -0.4},
    "Residential": {"night_ratio": 1.3, "evening_ratio": 0.8, "morning_ratio": -0.3, "poi_business_density": 0.2, "poi_food_density": -0.25, "poi_lifestyle_density": -0.25},
    "Transport Hub": {"charge_count": 1.1, "burstiness_p99_mean": 1.0, "load_cv": 0.6, "peak_load_kwh": 0.25},
    "Commercial / Mall": {"poi_food_density": 1.0, "poi_lifestyle_density": 1.0, "weekend_ratio": 0.7, "evening_ratio": 0.6, "mean_load_kwh": 0.15},
    "Industrial": {"charge_count": 0.8, "mean_load_kwh": 1.0, "load_cv": -1.1, "weekend_evenness": 0.6, "burstiness_p99_mean": -0.25},
}


def zone_scores(profiles: DataFrame) -> DataFrame:
    """zone_id and a score per category, from z-scores of features cut at their 5 and 95 percent points. Profiles are
    kept once, as three statistics are taken of them in turn."""
    names = sorted({f for w in CATEGORY_WEIGHTS.values() for f in w})
    frame = checkpoint(profiles.withColumn("weekend_evenness", 1 - F.abs(F.col("weekend_ratio") - 1)).select("zone_id", *[F.col(n).cast("double").alias(n) for n in names]))
    # A row per feature and fraction reaches the driver.
    middle = {r["name"]: r["value"] for r in quantiles(frame, names, [0.5]).collect()}
    frame = frame.fillna(middle)
    ends = {(r["name"], r["fraction"]): r["value"] for r in quantiles(frame, names, [0.05, 0.95]).collect()}
    cut = frame.withColumns({n: F.least(F.lit(ends[n, 0.95]), F.greatest(F.lit(ends[n, 0.05]), F.col(n))) for n in names if n in middle})
    stats = cut.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(n) for n in names]).first()
    z = {n: (F.col(n) - stats[n]["m"]) / stats[n]["s"] if stats[n]["s"] else F.lit(0.0) for n in names}
    return cut.select("zone_id", *[sum((w * z[n] for n, w in weights.items()), F.lit(0.0)).alias(category) for category, weights in CATEGORY_WEIGHTS.items()])


def assigned_categories(scores: DataFrame) -> list[tuple[str, str, float]]:
    """(category, zone, score): different zones, the largest total. Only each category's five best zones can matter,
    so 25 rows at most reach the driver."""
    kinds = list(CATEGORY_WEIGHTS)
    best = [[(r["zone_id"], r[k]) for r in scores.orderBy(F.desc(F.col(f"`{k}`")), "zone_id").select("zone_id", f"`{k}`").limit(len(kinds)).collect()] for k in kinds]
    options = [c for c in itertools.product(*best) if len({z for z, _ in c}) == len(kinds)]
    chosen = max(options, key=lambda c: sum(s for _, s in c))
    return [(k, z, s) for k, (z, s) in zip(kinds, chosen, strict=True)]


RANK_KEYS = ("mean_load_kwh", "load_cv", "peak_load_kwh")


def representative_zones(profiles: DataFrame, count: int, keys: Sequence[str] = RANK_KEYS) -> DataFrame:
    """zone_id, position (from 0), reason: the zones of the categories first, then evenly spaced ranks of a sort by the keys
    and zone_id, then the lowest ranks, until there are ``count``. Fewer than five zones are taken by zone_id.

    Ranks come from ranges of the sort and their sums; of a zone's reasons the first counts.
    """
    rows = checkpoint(profiles)
    n = rows.count()
    target = max(1, min(count, n))
    if n < len(CATEGORY_WEIGHTS):
        order = F.row_number().over(Window.orderBy("zone_id"))  # four zones at most
        return rows.select("zone_id").withColumns({"position": (order - 1).cast("long"), "reason": F.lit("zone")}).where(F.col("position") < target)
    spark = rows.sparkSession
    first = [(0, i, zone) for i, (_, zone, _) in enumerate(assigned_categories(checkpoint(zone_scores(rows))))]
    ranked = running_total(rows.select("zone_id", F.struct(*keys, "zone_id").alias("__order"), F.lit(1).alias("__one")), "__order", "__one", "__rank").select("zone_id", (F.col("__rank") - 1).alias("rank"))
    picks = [n // 2] if target == 1 else [round(i * (n - 1) / (target - 1)) for i in range(target)]
    spaced = spark.createDataFrame(list(enumerate(picks)), "i int, rank long").join(ranked, "rank").select(F.lit(1).alias("by"), "i", "zone_id")
    lowest = ranked.where(F.col("rank") < target + len(first)).select(F.lit(2).alias("by"), F.col("rank").cast("int").alias("i"), "zone_id")
    every = spark.createDataFrame(first, "by int, i int, zone_id string").unionByName(spaced).unionByName(lowest)
    chosen = every.groupBy("zone_id").agg(F.min(F.struct("by", "i")).alias("b"))  # some three times the count
    position = F.row_number().over(Window.orderBy("b.by", "b.i")) - 1
    reason = F.element_at(F.array(*map(F.lit, ("category", "rank", "fill"))), F.col("b.by") + 1)
    return chosen.select("zone_id", position.cast("long").alias("position"), reason.alias("reason")).where(F.col("position") < target)

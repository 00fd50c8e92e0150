"""From raw tables to the canonical series: columns, units, calendar, checks, joins and nearest centroids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial

KEY = ["timestamp", "zone_id"]
#: Centroids stand as one array beside each point up to this many; beyond, points go through an index of cells.
JOIN_CENTROIDS = 2_000


def discover_column(columns: Sequence[str], aliases: Sequence[str], required: bool = True) -> str | None:
    """The one column that an alias names, in any case; none or several is an error."""
    wanted = {a.lower() for a in aliases}
    found = [c for c in columns if c.lower() in wanted]
    if len(found) > 1 or (required and not found):
        raise ValueError(f"{'ambiguous' if found else 'missing'} column for {', '.join(aliases)}: {found}")
    return found[0] if found else None


def aliased(df: DataFrame, aliases: dict[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Rename columns to their canonical names, from what aliases find."""
    found = {name: discover_column(df.columns, names, name not in optional) for name, names in aliases.items()}
    return df.withColumnsRenamed({old: new for new, old in found.items() if old})


def converted(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Fields as numbers (null where they aren't), times their factors."""
    return df.withColumns({name: F.col(name).try_cast("double") * factor for name, factor in factors.items()})


def calendar(df: DataFrame, time: str = "timestamp") -> DataFrame:
    day = F.weekday(time)
    return df.withColumns({"hour": F.hour(time), "day_of_week": day, "is_weekend": (day >= 5).cast("int")})


def violations(series: DataFrame) -> DataFrame:
    """One row: what is wrong with a canonical series (zeros if nothing)."""
    keys = series.groupBy(*KEY).agg(F.count("*").alias("n"), F.count("load_kwh").alias("loads"), F.count_if(F.col("energy_price").isNull() | (F.col("energy_price") <= 0)).alias("prices"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        (F.coalesce(F.sum("loads"), F.lit(0)) == 0).alias("no_load"), F.coalesce(F.sum("prices"), F.lit(0)).alias("bad_prices"),
    )


def validated(series: DataFrame) -> DataFrame:
    """The series itself; an error tells what is wrong."""
    found = violations(series).first()
    if found.rows == 0 or found.duplicate_keys or found.no_load or found.bad_prices:
        raise ValueError(f"invalid series: {found.asDict()}")
    return series


def first_per(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row per key, the first by the given order."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", number).where("__n = 1").drop("__n")


def selected_zones(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted zones (zone_id, position), with the position."""
    return df.join(wanted, "zone_id")


def unknown_zones(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(df.select("zone_id").distinct(), "zone_id", "left_anti")


def horizon(series: DataFrame, origin: Column, hours: int, known: Sequence[str]) -> DataFrame:
    """What is known of the hours from ``origin`` on: every hour for every zone, no actual load."""
    grid = series.select("zone_id").distinct().select("zone_id", F.explode(F.sequence(origin, origin + F.expr(f"interval {hours - 1} hours"), F.expr("interval 1 hour"))).alias("timestamp"))
    return grid.join(series.select(*KEY, *known), KEY, "left")


def site_exclusions(prices: DataFrame, loads: DataFrame) -> DataFrame:
    """site_id, reason: a price that is unknown or not positive, else a load that is unknown or negative."""
    price = prices.groupBy("zone_id").agg(F.bool_and(F.coalesce(F.col("energy_price") > 0, F.lit(False))).alias("price_ok"))
    load = loads.groupBy("zone_id").agg(F.bool_and(F.coalesce(F.col("load_kwh") >= 0, F.lit(False))).alias("load_ok"))
    both = price.join(load, "zone_id", "full_outer")
    reason = F.when(~F.coalesce("price_ok", F.lit(False)), "invalid_price").when(~F.coalesce("load_ok", F.lit(False)), "invalid_energy")
    return both.select("zone_id", reason.alias("reason")).where("reason IS NOT NULL")


def merged_series(load: DataFrame, price: DataFrame, optional: Sequence[DataFrame] = (), weather: DataFrame | None = None) -> DataFrame:
    """Load and price where both are, optional series where they are, weather by hour for every zone."""
    out = load.join(price, KEY)
    for one in optional:
        out = out.join(one, KEY, "left")
    if weather is not None:
        out = out.join(F.broadcast(weather), "timestamp", "left")  # a row per hour: bounded by time, not by zones
    return out


def tariff_hours(tariffs: DataFrame) -> DataFrame:
    """month, hour, label, prices of tariff texts such as ``Peak(08:00-11:00, 22:00-00:00)``.

    A span ends before its last hour and may pass midnight. Sharp goes before Peak; any other overlap, or two
    prices of one label, gives a row with ``conflict``.
    """
    label = F.lower(F.trim(F.split("period", r"\(")[0]))
    spans = F.expr(r"regexp_extract_all(period, '(\\d{2}:00\\s*-\\s*\\d{2}:00)', 1)")
    rank = F.array_position(F.array(*[F.lit(x) for x in ("off-peak", "shoulder", "peak", "sharp")]), F.col("label"))
    start, end = F.substring("span", 1, 2).cast("int"), F.substring("span", -5, 2).cast("int")
    after = F.when(end > start, end).otherwise(end + 24)
    rows = tariffs.withColumns({"label": label, "span": F.explode(spans)}).withColumn("h", F.explode(F.sequence(start, after - 1))).withColumns({"hour": F.col("h") % 24, "rank": rank})
    best = F.max(F.struct("rank", "label", "energy_price", "service_price"))
    return rows.groupBy("month", "hour").agg(
        best.alias("b"),
        (F.bool_or(F.col("rank") < 3) & (F.count_distinct("label") > 1) | (F.count_distinct("label", "energy_price", "service_price") > F.count_distinct("label"))).alias("conflict"),
    ).select("month", "hour", "b.label", "b.energy_price", "b.service_price", "conflict")


def nearest_centroid(points: DataFrame, centroids: DataFrame, scale_longitude: bool = False, count: int | None = None) -> DataFrame:
    """point_id, zone_id, distance2: each point's nearest centroid (zone_id, longitude, latitude, ordinal).

    Of equally near ones, the first by ``ordinal``. With ``scale_longitude``, longitudes shrink with the cosine of the
    centroids' mean latitude. ``count``: how many centroids there are, counted if not given.
    """
    n = centroids.count() if count is None else count
    shrink = float(np.cos(np.radians(centroids.agg(F.avg("latitude")).first()[0] or 0.0))) if scale_longitude else 1.0
    if n <= JOIN_CENTROIDS:
        # All centroids as one array beside each point: no shuffle, and no row per pair.
        every = centroids.agg(F.collect_list(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"), "ordinal", "zone_id")).alias("__zones"))

        def away(z: Column) -> Column:
            dx, dy = (F.col("longitude") - z["x"]) * shrink, F.col("latitude") - z["y"]
            return F.struct((dx * dx + dy * dy).alias("distance2"), z["ordinal"].alias("ordinal"), z["zone_id"].alias("zone_id"))

        near = points.crossJoin(F.broadcast(every)).withColumn("b", F.array_min(F.transform("__zones", away)))
        return near.where("b IS NOT NULL").select("point_id", "b.zone_id", "b.distance2")
    return spatial.nearest(points, centroids, shrink, n)


def price_override(hourly: DataFrame, windows: DataFrame) -> DataFrame:
    """Hourly rows (keys zone_id, timestamp) with the price of the last proposed window that holds the hour.

    Windows (zone_id, window_start, window_end, position, proposed_energy_price) hold both their ends; negative or
    missing prices don't count. Windows become hours and join by key, so no range join is needed.
    """
    valid = windows.where("proposed_energy_price >= 0")
    hours = valid.select("zone_id", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 hour"))).alias("timestamp"), "position", "proposed_energy_price")
    last = hours.groupBy("zone_id", "timestamp").agg(F.max_by("proposed_energy_price", "position").alias("__price"))
    return hourly.join(last, ["zone_id", "timestamp"], "left").withColumn("energy_price", F.coalesce("__price", "energy_price")).drop("__price")

"""Readers of wide matrices, stations with tariffs, saved forecasts and saved control results."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import datetime_24h
from ..operators import features as A
from ..operators import prepare as P
from .results import read_results

TIME_NAMES = ("time", "timestamp", "datetime", "_c0")

_CELL = r',("(?:[^"\\]|\\.|"")*+"|[^,]*+)'


def cells(line: Column) -> Column:
    """The texts of a CSV line's cells, those in quotes without them; empty ones are empty texts."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    bare = lambda c: F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r'[\\"](["\\])', "$1")
    quoted = F.transform(found, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), bare(c)).otherwise(c))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def _wide(spark: SparkSession, path: str) -> tuple[DataFrame, int, list[str]]:
    """Each line as an array of texts (``cells``), so that zone ids keep leading zeros and nothing is guessed; the place of
    the time; all columns' names. An unnamed column is ``_c`` and its place; names that repeat get theirs behind them.

    Lines are read as texts and those like the header are told by its hash, in whatever files and places they stand: with many
    zones the header is long, and as a column's name it would stand in each text of each plan that the driver keeps.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.xxhash64("value").alias("hash"))
    header = lines.first()
    if header is None:
        raise ValueError(f"no header in {path}")
    given = next(csv.reader([header["value"]], escapechar="\\"))
    seen = Counter(n.lower() for n in given)
    names = [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(given)]
    time = P.discover_column(names, TIME_NAMES)
    return lines.where(F.col("hash") != header["hash"]).select(cells(F.col("value")).alias("cells")), names.index(time), names


def _time_of(place: int) -> Column:
    return datetime_24h(F.get("cells", F.lit(place)))


def read_wide_matrix(spark: SparkSession, path: str, value: str) -> DataFrame:
    """timestamp, zone_id, value of a file with one column per zone; what isn't a number is null."""
    lines, time, names = _wide(spark, path)
    zones = spark.createDataFrame(pa.table({"pos": pa.array(range(len(names)), pa.int32()), "zone_id": pa.array(names, pa.string())})).where(F.col("pos") != time)
    # Short lines are filled up with nulls; cells beyond the header go with the join.
    missing = F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(0), F.lit(len(names)) - F.size("cells")))
    long = lines.select(_time_of(time).alias("timestamp"), F.posexplode(F.concat("cells", missing)).alias("pos", "__text"))
    # The names are broadcast: they are one line of the file, as any of its readers holds.
    return long.join(F.broadcast(zones), "pos").select("timestamp", "zone_id", F.col("__text").try_cast("double").alias(value))


def hourly_matrix_violations(spark: SparkSession, path: str) -> DataFrame:
    """One row: unknown or repeated times, times that aren't whole hours, missing hours, cells that aren't numbers."""
    lines, time, names = _wide(spark, path)
    numbers = F.filter("cells", lambda c, i: (i != time) & (i < len(names)) & c.try_cast("double").isNotNull())
    per = lines.select(_time_of(time).alias("t"), (F.lit(len(names) - 1) - F.size(numbers)).alias("bad")).groupBy("t").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hours = (F.unix_seconds(F.max("t").cast("timestamp")) - F.unix_seconds(F.min("t").cast("timestamp"))) / 3600 + 1
    whole = F.count_if((F.minute("t") == 0) & (F.second("t") == 0))
    return per.agg(
        F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("unknown_times"), F.count_if(F.col("t").isNotNull() & (F.col("n") > 1)).alias("repeated_times"),
        (F.count("t") - whole).alias("odd_times"), (hours.cast("long") - whole).alias("missing_hours"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_cells"),
    )


def read_hourly_matrix(spark: SparkSession, path: str, value: str) -> DataFrame:
    """As read_wide_matrix, but anything irregular is an error."""
    found = hourly_matrix_violations(spark, path).first()
    if any(found):
        raise ValueError(f"irregular matrix {path}: {found.asDict()}")
    return read_wide_matrix(spark, path, value)


def city_series(spark: SparkSession, load: str, price: str, service: str | None = None, occupancy: str | None = None, weather: DataFrame | None = None) -> DataFrame:
    """The canonical series from wide files: load and price where both are, the others where they are."""
    more = [read_wide_matrix(spark, path, name) for path, name in ((service, "service_price"), (occupancy, "occupancy")) if path]
    series = P.calendar(P.merged_series(read_wide_matrix(spark, load, "load_kwh"), read_wide_matrix(spark, price, "energy_price"), more, weather))
    if weather is None:
        return series
    return series.withColumn("temperature_price_interaction", F.col("temperature") * F.col("energy_price"))


def site_series(spark: SparkSession, load: str, price: str) -> tuple[DataFrame, DataFrame]:
    """The series of sites whose prices and loads are valid throughout, and the other sites with the reason."""
    loads, prices = read_hourly_matrix(spark, load, "load_kwh"), read_hourly_matrix(spark, price, "energy_price")
    excluded = P.site_exclusions(prices, loads)
    return P.calendar(P.merged_series(loads, prices).join(excluded, "zone_id", "left_anti")), excluded


def station_series(power: DataFrame, tariffs: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Hourly station power (zone_id, timestamp, power_kw, session_count) with tariffs (zone_id, month, period, prices).

    One tariff year is kept. Stations with session counts, without tariff, or with hours that the tariff lacks are left out, with
    the reason.
    """
    rows = power.where(F.year("timestamp") == year)
    hours = tariffs.groupBy("zone_id").agg(F.lit(True).alias("has_tariff"))
    parts = tariffs.select("zone_id").distinct().join(tariffs, "zone_id")
    expanded = _tariffs_by_zone(parts)
    joined = rows.withColumns({"month": F.month("timestamp"), "hour": F.hour("timestamp")}).join(expanded, ["zone_id", "month", "hour"], "left")
    per = joined.groupBy("zone_id").agg(F.bool_or(F.col("session_count").isNotNull()).alias("counts"), F.bool_or(F.col("energy_price").isNull()).alias("lacks")).join(hours, "zone_id", "left")
    reason = F.when(F.col("counts"), "transaction_counts").when(F.col("has_tariff").isNull(), "missing_tariff").when(F.col("lacks"), "incomplete_tariff")
    excluded = per.select("zone_id", reason.alias("reason")).where("reason IS NOT NULL")
    kept = joined.join(excluded, "zone_id", "left_anti").select("timestamp", "zone_id", F.col("power_kw").alias("load_kwh"), "energy_price", "service_price")
    return P.calendar(kept), excluded


def _tariffs_by_zone(tariffs: DataFrame) -> DataFrame:
    """Hours of each zone's tariff: zones with equal tariffs are expanded once."""
    key = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("month", "period", "energy_price", "service_price")))), 256)
    of_zone = tariffs.groupBy("zone_id").agg(key.alias("tariff"))
    one = tariffs.join(of_zone.groupBy("tariff").agg(F.min("zone_id").alias("zone_id")), "zone_id")
    label = F.lower(F.trim(F.split("period", r"\(")[0]))
    rank = F.array_position(F.array(*[F.lit(x) for x in ("off-peak", "shoulder", "peak", "sharp")]), label)
    spans = F.explode(F.expr(r"regexp_extract_all(period, '(\\d{2}:00\\s*-\\s*\\d{2}:00)', 1)"))
    rows = one.withColumns({"rank": rank, "span": spans}).withColumns({"start": F.substring("span", 1, 2).cast("int"), "end": F.substring("span", -5, 2).cast("int")})
    until = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("end") + 24) - 1
    hours = rows.withColumn("h", F.explode(F.sequence("start", until))).withColumn("hour", F.col("h") % 24)
    best = hours.groupBy("tariff", "month", "hour").agg(F.max(F.struct("rank", "energy_price", "service_price")).alias("b"))
    return of_zone.join(best, "tariff").select("zone_id", "month", "hour", "b.energy_price", "b.service_price")


def read_forecast_details(spark: SparkSession, path: str, schema: str, legacy: dict[str, str]) -> DataFrame:
    """Saved forecast files below ``path``, with the run from ``run=...`` in each file's path, older names renamed."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(schema).csv(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)", 1)
    out = raw.withColumn("run", run)
    for old, new in legacy.items():
        out = out.withColumn(new, F.coalesce(new, old)).drop(old)
    return out


def read_control_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested control results below ``path``, one run per line, of schema versions 2 to 4 under today's names; lines that
    can't be read are left out (``results.read_results`` gives them apart)."""
    return read_results(spark, path)[0]


def flat_windows(results: DataFrame, keys: Sequence[str], phase: str) -> DataFrame:
    """Windows of nested results, with all their fields: ``final`` ones, or those of all attempts (with ``attempt``)."""
    zones = results.select(*keys, F.explode_outer("zones").alias("z"))
    if phase == "final":
        return zones.select(*keys, "z.zone_id", F.explode_outer("z.final_windows").alias("w")).select(*keys, "zone_id", "w.*").where("window_start IS NOT NULL")
    attempts = zones.select(*keys, "z.zone_id", F.explode_outer("z.attempt_trace").alias("a"))
    return attempts.select(*keys, "zone_id", "a.attempt", F.explode_outer("a.windows").alias("w")).select(*keys, "zone_id", "attempt", "w.*").where("window_start IS NOT NULL")


def flat_calls(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    attempts = results.select(*keys, F.explode_outer("zones").alias("z")).select(*keys, "z.zone_id", F.explode_outer("z.attempt_trace").alias("a"))
    return attempts.select(*keys, "zone_id", "a.attempt", F.explode_outer("a.calls").alias("c")).select(*keys, "zone_id", "attempt", "c.*").where("agent IS NOT NULL")


def station_statics(stations: DataFrame, near: DataFrame) -> DataFrame:
    """Zone statics: station profiles with the counts of the points nearest to each zone."""
    return A.station_profile(stations).join(near, "zone_id", "left").fillna(0)

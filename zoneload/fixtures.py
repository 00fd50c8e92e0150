"""The library's input tables, derived from the given ones: Spark views and the same views for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import dealt

#: 30 days of hours.
FIRST, LAST = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
ORIGIN = "2024-01-22 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truncated(unit: str, column: str):
    """date_trunc that keeps wall-clock time."""
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def hours(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{FIRST}', timestamp_ntz'{LAST}', interval 1 hour)")).alias("timestamp"))


def zone_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hourly load and occupancy, with gaps: a zone for each event type and 40 users, so zones grow with users."""
    events = table(spark, sf_dir, "events")
    zone = F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 40).cast("string")).alias("zone_id")
    load = F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("load_kwh")
    return events.groupBy(zone, truncated("hour", "ts").alias("timestamp")).agg(load, (F.sum(F.col("user_id") % 10) / F.count("*") / 10).alias("occupancy"))


def weather(spark: SparkSession) -> DataFrame:
    day, hour = F.dayofmonth("timestamp"), F.hour("timestamp")
    return hours(spark).select(
        "timestamp",
        (5 + (day * 3 + hour) % 17).cast("double").alias("temperature"),
        (40 + (day + hour * 2) % 50).cast("double").alias("humidity"),
        F.when((day * 24 + hour) % 11 == 0, 1.5).otherwise(0.0).alias("rain"),
    )


def zone_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical series: every zone and hour, missing load 0.

    Zones are few bytes, but 720 rows each: they are dealt to a partition for each 100,000 events before they meet the
    hours, as adaptive execution would put them all into one task.
    """
    raw = zone_hourly(spark, sf_dir)
    zones = dealt(raw.select("zone_id").distinct(), table(spark, sf_dir, "events").count(), ["zone_id"], 100_000)
    day, hour = F.dayofmonth("timestamp"), F.hour("timestamp")
    tariff = F.when(hour < 7, 40).when(hour < 17, 70).otherwise(110)
    return (
        zones.crossJoin(F.broadcast(weather(spark)))
        .join(raw, ["zone_id", "timestamp"], "left")
        .select(
            "timestamp", "zone_id", F.coalesce("load_kwh", F.lit(0.0)).alias("load_kwh"),
            ((tariff + F.length("zone_id") + (day * 7 + hour) % 5) / 100).alias("energy_price"),
            ((30 + hour % 4) / 100).alias("service_price"),
            "occupancy", "temperature", "humidity", "rain",
            hour.alias("hour"), F.weekday("timestamp").alias("day_of_week"), (F.weekday("timestamp") >= 5).cast("int").alias("is_weekend"),
        )
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.concat(F.lit("z"), F.col("s_nationkey").cast("string")).alias("zone_id"),
        (114 + (F.col("s_suppkey") * 37 % 1000) / 1000).alias("longitude"), (22 + (F.col("s_suppkey") * 53 % 1000) / 1000).alias("latitude"),
        (1 + F.col("s_suppkey") % 9).alias("charge_count"), (1000000 + F.col("s_suppkey") % 7 * 500000).cast("double").alias("area"), (4000 + F.col("s_suppkey") % 5 * 100).cast("double").alias("perimeter"),
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("food and beverage services", "business residence", "lifestyle services", "scenic spot")])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("poi_id"), kinds[(F.col("p_partkey") % 4).cast("int")].alias("primary_types"),
        (114 + (F.col("p_partkey") * 61 % 997) / 997).alias("longitude"), (22 + (F.col("p_partkey") * 29 % 991) / 991).alias("latitude"),
    )


def forecast_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and predicted load by zone, time and model, with intervals, origins and what is known of the training
    period; copies of some rows come from another agent mode."""
    k, line, predicted = F.col("l_orderkey"), F.col("l_linenumber"), F.round(F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax")), 4)
    origin = truncated("week", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("zone"), F.col("l_shipdate").alias("time"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("batch"), k.alias("run"), line.alias("line"),
        F.when(k % 19 == 0, F.lit(None)).when(k % 13 == 0, 0.0).otherwise(F.col("l_quantity")).alias("actual_kwh"), predicted.alias("predicted_kwh"),
        F.when(k % 11 != 0, predicted * 0.95).alias("q10_kwh"), (predicted * 1.05).alias("q90_kwh"), origin.alias("origin"),
        F.when(k % 4 != 3, (k % 40 == 1) & (F.col("l_returnflag") == "R")).alias("training_overlap"),
        F.when((F.col("l_returnflag") != "N") | (k % 6 != 0), (origin - F.make_dt_interval(days=F.lit(1))).cast("timestamp_ntz")).alias("training_end"),
    )
    return rows.withColumn("agent_mode", F.lit("multi")).unionByName(rows.where("line = 1").withColumn("agent_mode", F.lit("single")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved run per order: batch, mode, identity, signature. As customers order at will, identities have some modes
    once, some several times and some not at all; some signatures are unknown or inconsistent."""
    k, identity = F.col("o_orderkey"), F.col("o_custkey") * 4 + F.floor(F.col("o_orderkey") / 6).cast("long") % 4
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 3).alias("batch"), F.floor(k / 3).cast("long").alias("__m"), identity.alias("identity"),
        F.when(k % 31 == 0, F.lit(None)).otherwise(identity + F.when(k % 29 == 0, 1000).otherwise(0)).alias("signature"),
        F.when(k % 7 != 6, k % 7 > 1).alias("first_success"), F.when(k % 11 != 5, k % 11 > 2).alias("final_success"), F.when(k % 9 != 4, k * 10).alias("tokens"),
    ).select("k", "batch", (F.col("__m") % 2).alias("mode"), "identity", "signature", "first_success", "final_success", "tokens")


def window_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (64 orders each), zone, window, round (0: baseline), the load of all their items, the first order as key;
    some stress labels are missing, and so are rounds without an item. Items are dealt by run, so what is grouped by it stays."""
    cell = [F.floor(F.col("l_orderkey") / 64).cast("long").alias("run"), (F.col("l_suppkey") % 5).alias("zone"), (F.col("l_partkey") % 8).alias("window"), (F.col("l_linenumber") % 4).cast("long").alias("round")]
    position, items = F.col("load_kwh") * 2, table(spark, sf_dir, "lineitem")
    rows = dealt(items.select(*cell, "l_quantity", "l_orderkey"), items.count(), ["run"], 200_000)
    return rows.groupBy("run", "zone", "window", "round").agg(F.sum("l_quantity").alias("load_kwh"), F.min("l_orderkey").alias("key")).withColumn(
        "stress", F.when(F.col("key") % 10 == 3, F.lit(None)).when(position < 35, "Low").when(position < 80, "Medium").when(position < 90, "High").otherwise("Extremely High")
    )


def run_finals(rounds: DataFrame, **more: Column) -> DataFrame:
    """run, zone, window with the state of the last round, and the run's status and rounds: some stop early; ``more``:
    aggregates of a window's rounds to give beside."""
    last = F.max(F.struct("round", "load_kwh", "stress"))
    got = rounds.groupBy("run", "zone", "window").agg(last.alias("l"), *[c.alias(n) for n, c in more.items()])
    return got.select("run", "zone", "window", F.when(F.col("run") % 5 < 3, "success").otherwise("fail").alias("status"), (F.col("run") % 4).alias("attempts_used"), F.lit(3).cast("long").alias("attempt_limit"), "l.load_kwh", "l.stress", *more)


def agent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call: tokens from text lengths, unknown for some."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.col("role").alias("agent"), (F.col("turn") % 3).alias("attempt"),
        F.when(F.col("turn") % 7 != 6, n).cast("long").alias("prompt_tokens"), F.when(F.col("turn") % 7 != 6, F.floor(n / 2)).cast("long").alias("completion_tokens"),
        F.when(F.col("turn") % 5 != 4, F.floor(n / 3) + F.when(F.col("conv_id") % 17 == 0, 10000).otherwise(0)).cast("long").alias("cached_tokens"),
        (F.col("conv_id") % 13 != 0).alias("token_usage_complete"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type by scrape (hour), set back every 200 hours; scrapes without events are missed."""
    from pyspark.sql import Window

    per = zone_hourly(spark, sf_dir).groupBy(F.expr("substring_index(zone_id, '-', 1)").alias("name"), "timestamp").agg(F.sum(F.col("load_kwh").cast("decimal(18,2)")).alias("v"))
    scrape = F.expr(f"cast((unix_seconds(cast(timestamp as timestamp)) - unix_seconds(cast(timestamp_ntz'{FIRST}' as timestamp))) / 3600 as bigint)")
    rows = per.withColumn("scrape_index", scrape)
    epoch = F.floor(F.col("scrape_index") / 200)
    return rows.withColumn("value", F.sum("v").over(Window.partitionBy("name", epoch).orderBy("scrape_index")).cast("double")).select("name", "scrape_index", "timestamp", "value")


_DAY, _HOUR = "extract(day FROM timestamp)", "extract(hour FROM timestamp)"
HOURLY = """zone_hourly AS (
    SELECT event_type || '-' || (user_id // 40) AS zone_id, date_trunc('hour', ts) AS timestamp,
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS load_kwh, sum(user_id % 10) / count(*) / 10 AS occupancy
    FROM events GROUP BY ALL)"""
SERIES = f"""{HOURLY},
hours AS (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 HOUR)) AS timestamp),
weather AS (
    SELECT timestamp, CAST(5 + ({_DAY} * 3 + {_HOUR}) % 17 AS DOUBLE) AS temperature, CAST(40 + ({_DAY} + {_HOUR} * 2) % 50 AS DOUBLE) AS humidity,
        CASE WHEN ({_DAY} * 24 + {_HOUR}) % 11 = 0 THEN 1.5e0 ELSE 0e0 END AS rain FROM hours),
zone_series AS (
    SELECT timestamp, zone_id, coalesce(load_kwh, 0) AS load_kwh,
        (CASE WHEN {_HOUR} < 7 THEN 40 WHEN {_HOUR} < 17 THEN 70 ELSE 110 END + length(zone_id) + ({_DAY} * 7 + {_HOUR}) % 5) / 100e0 AS energy_price,
        (30 + {_HOUR} % 4) / 100e0 AS service_price, occupancy, temperature, humidity, rain,
        CAST({_HOUR} AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, CAST(isodow(timestamp) > 5 AS INTEGER) AS is_weekend
    FROM (SELECT DISTINCT zone_id FROM zone_hourly) CROSS JOIN weather LEFT JOIN zone_hourly USING (zone_id, timestamp))"""
STATIONS = """stations AS (
    SELECT s_suppkey AS station_id, 'z' || s_nationkey AS zone_id, 114 + (s_suppkey * 37 % 1000) / 1000e0 AS longitude, 22 + (s_suppkey * 53 % 1000) / 1000e0 AS latitude,
        1 + s_suppkey % 9 AS charge_count, CAST(1000000 + s_suppkey % 7 * 500000 AS DOUBLE) AS area, CAST(4000 + s_suppkey % 5 * 100 AS DOUBLE) AS perimeter FROM supplier),
poi AS (
    SELECT p_partkey AS poi_id, (['food and beverage services', 'business residence', 'lifestyle services', 'scenic spot'])[p_partkey % 4 + 1] AS primary_types,
        114 + (p_partkey * 61 % 997) / 997e0 AS longitude, 22 + (p_partkey * 29 % 991) / 991e0 AS latitude FROM part)"""
SAMPLES = """base_samples AS (
    SELECT *, CASE WHEN run % 11 <> 0 THEN predicted_kwh * 0.95e0 END AS q10_kwh, predicted_kwh * 1.05e0 AS q90_kwh, CASE WHEN run % 4 <> 3 THEN run % 40 = 1 AND model = 'R' END AS training_overlap,
        CASE WHEN model <> 'N' OR run % 6 <> 0 THEN origin - INTERVAL 1 DAY END AS training_end
    FROM (SELECT l_suppkey % 10 AS zone, l_shipdate AS time, l_returnflag AS model, l_linestatus AS batch, l_orderkey AS run, l_linenumber AS line,
            CASE WHEN l_orderkey % 19 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 0 ELSE l_quantity END AS actual_kwh, round(l_quantity * (1 + l_discount - l_tax), 4) AS predicted_kwh,
            CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS origin FROM lineitem)),
forecast_samples AS (SELECT *, 'multi' AS agent_mode FROM base_samples UNION ALL SELECT *, 'single' FROM base_samples WHERE line = 1)"""
RUNS = """runs AS (
    SELECT k, k % 3 AS batch, k // 3 % 2 AS mode, identity, CASE WHEN k % 31 = 0 THEN NULL ELSE identity + CASE WHEN k % 29 = 0 THEN 1000 ELSE 0 END END AS signature,
        CASE WHEN k % 7 <> 6 THEN k % 7 > 1 END AS first_success, CASE WHEN k % 11 <> 5 THEN k % 11 > 2 END AS final_success, CASE WHEN k % 9 <> 4 THEN k * 10 END AS tokens
    FROM (SELECT o_orderkey AS k, o_custkey * 4 + o_orderkey // 6 % 4 AS identity FROM orders))"""
ROUNDS = """window_rounds AS (
    SELECT *, CASE WHEN key % 10 = 3 THEN NULL WHEN load_kwh * 2 < 35 THEN 'Low' WHEN load_kwh * 2 < 80 THEN 'Medium' WHEN load_kwh * 2 < 90 THEN 'High' ELSE 'Extremely High' END AS stress
    FROM (SELECT l_orderkey // 64 AS run, l_suppkey % 5 AS zone, l_partkey % 8 AS "window", CAST(l_linenumber % 4 AS BIGINT) AS round, sum(l_quantity) AS load_kwh, min(l_orderkey) AS key FROM lineitem GROUP BY ALL)),
run_finals AS (
    SELECT run, zone, "window", CASE WHEN run % 5 < 3 THEN 'success' ELSE 'fail' END AS status, run % 4 AS attempts_used, 3 AS attempt_limit, l.load_kwh AS load_kwh, l.stress AS stress
    FROM (SELECT run, zone, "window", arg_max({'load_kwh': load_kwh, 'stress': stress}, round) AS l FROM window_rounds GROUP BY ALL))"""
CALLS = """agent_calls AS (
    SELECT conv_id AS run, turn AS step, role AS agent, turn % 3 AS attempt, CASE WHEN turn % 7 <> 6 THEN length(text) END AS prompt_tokens,
        CASE WHEN turn % 7 <> 6 THEN length(text) // 2 END AS completion_tokens,
        CASE WHEN turn % 5 <> 4 THEN length(text) // 3 + CASE WHEN conv_id % 17 = 0 THEN 10000 ELSE 0 END END AS cached_tokens, conv_id % 13 <> 0 AS token_usage_complete
    FROM conversations)"""
SCRAPES = f"""{HOURLY},
metric_samples AS (
    SELECT name, scrape_index, timestamp, CAST(sum(v) OVER (PARTITION BY name, scrape_index // 200 ORDER BY scrape_index) AS DOUBLE) AS value
    FROM (SELECT split_part(zone_id, '-', 1) AS name, timestamp, sum(CAST(load_kwh AS DECIMAL(18, 2))) AS v,
            CAST(epoch(timestamp) - epoch(TIMESTAMP '{FIRST}') AS BIGINT) // 3600 AS scrape_index FROM zone_hourly GROUP BY ALL))"""

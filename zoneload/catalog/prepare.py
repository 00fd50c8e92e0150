"""Queries over preparation operators."""

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import features as A
from ..operators import intervals as I
from ..operators import prepare as P
from ..registry import query

_O = f"TIMESTAMP '{X.ORIGIN}'"
_C = F.col


def origin():
    return F.lit(X.ORIGIN).cast("timestamp_ntz")


@query("prj_alias_columns", "SELECT timestamp, zone_id, load_kwh, occupancy FROM zone_hourly", X.HOURLY, "load_kwh occupancy")
def alias_columns(spark, d):
    raw = X.zone_hourly(spark, d).withColumnsRenamed({"timestamp": "DateTime", "zone_id": "Station", "load_kwh": "VOLUME"})
    return P.aliased(raw, {"timestamp": ["time", "datetime"], "zone_id": ["zone", "station"], "load_kwh": ["load", "volume"], "energy_price": ["price"]}, ["energy_price"]).select("timestamp", "zone_id", "load_kwh", "occupancy")


@query("prj_unit_conversion", "SELECT timestamp, zone_id, load_kwh / 1000 AS load_kwh, energy_price * 7.2e0 AS energy_price FROM zone_series", X.SERIES, "load_kwh energy_price")
def unit_conversion(spark, d):
    return P.converted(X.zone_series(spark, d), {"load_kwh": 0.001, "energy_price": 7.2}).select("timestamp", "zone_id", "load_kwh", "energy_price")


@query("prj_calendar", "SELECT o_orderkey, o_orderdate, CAST(extract(hour FROM o_orderdate) AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(isodow(o_orderdate) > 5 AS INTEGER) AS is_weekend FROM orders")
def calendar(spark, d):
    return P.calendar(X.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("prj_temp_price", "SELECT timestamp, zone_id, temperature * energy_price AS temperature_price_interaction FROM zone_series", X.SERIES, "temperature_price_interaction")
def temp_price(spark, d):
    return X.zone_series(spark, d).select("timestamp", "zone_id", (_C("temperature") * _C("energy_price")).alias("temperature_price_interaction"))


@query("flt_validate_series", """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicate_keys, coalesce(sum(loads), 0) = 0 AS no_load, CAST(coalesce(sum(prices), 0) AS BIGINT) AS bad_prices
    FROM (SELECT timestamp, zone_id, count(*) AS n, count(load_kwh) AS loads, count(*) FILTER (energy_price IS NULL OR energy_price <= 0) AS prices FROM (SELECT * FROM zone_series UNION ALL SELECT * FROM zone_series WHERE hour = 5) GROUP BY ALL)""", X.SERIES)
def validate_series(spark, d):
    series = X.zone_series(spark, d)
    return P.violations(series.unionByName(series.where("hour = 5")))


@query("flt_static_dedupe", "SELECT zone_id, station_id, area FROM stations QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY station_id) = 1", X.STATIONS)
def static_dedupe(spark, d):
    return P.first_per(X.stations(spark, d), "zone_id", "station_id").select("zone_id", "station_id", "area")


_WANTED = "wanted AS (SELECT zone_id, row_number() OVER (ORDER BY zone_id DESC) AS position FROM (SELECT DISTINCT zone_id FROM zone_hourly WHERE zone_id LIKE '%-1' UNION SELECT 'none-1'))"


def _wanted(spark, d):
    from pyspark.sql import Window

    ids = X.zone_hourly(spark, d).select("zone_id").distinct().where("zone_id LIKE '%-1'").union(spark.createDataFrame([("none-1",)], "zone_id string"))
    return ids.withColumn("position", F.row_number().over(Window.orderBy(F.desc("zone_id"))).cast("long"))


@query("flt_select_zones", "SELECT zone_id, position, true AS known, count(*) AS n FROM zone_hourly JOIN wanted USING (zone_id) GROUP BY ALL UNION ALL SELECT zone_id, position, false, 0 FROM wanted WHERE zone_id NOT IN (SELECT zone_id FROM zone_hourly)", f"{X.HOURLY}, {_WANTED}")
def select_zones(spark, d):
    rows, wanted = X.zone_hourly(spark, d), _wanted(spark, d)
    found = P.selected_zones(rows, wanted).groupBy("zone_id", "position").agg(F.lit(True).alias("known"), F.count("*").alias("n"))
    return found.unionByName(P.unknown_zones(rows, wanted).select("zone_id", "position", F.lit(False).alias("known"), F.lit(0).cast("long").alias("n")))


@query("flt_before_origin", f"SELECT zone_id, origin, count(*) AS rows, max(timestamp) AS last FROM zone_hourly, (SELECT unnest(generate_series({_O}, {_O} + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS origin) WHERE timestamp < origin GROUP BY ALL", X.HOURLY)
def before_origin(spark, d):
    origins = spark.range(6).select((origin() + F.make_dt_interval(days=_C("id").cast("int"))).alias("origin"))
    return X.zone_hourly(spark, d).join(F.broadcast(origins), _C("timestamp") < _C("origin")).groupBy("zone_id", "origin").agg(F.count("*").alias("rows"), F.max("timestamp").alias("last"))


@query("prj_known_future", f"""SELECT z.zone_id, h.timestamp, o.occupancy FROM (SELECT DISTINCT zone_id FROM zone_hourly) z CROSS JOIN (SELECT unnest(generate_series({_O}, {_O} + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS timestamp) h
    LEFT JOIN zone_hourly o ON o.zone_id = z.zone_id AND o.timestamp = h.timestamp""", X.HOURLY, "occupancy")
def known_future(spark, d):
    return P.horizon(X.zone_hourly(spark, d), origin(), 24, ["occupancy"])


@query("prj_zone_frame", "SELECT zone_id, timestamp AS time, load_kwh AS actual_kwh, energy_price AS e_price, service_price AS s_price, occupancy, temperature AS T, humidity AS U, rain AS nRAIN, hour, is_weekend FROM zone_series", X.SERIES, "occupancy")
def zone_frame(spark, d):
    names = {"timestamp": "time", "load_kwh": "actual_kwh", "energy_price": "e_price", "service_price": "s_price", "temperature": "T", "humidity": "U", "rain": "nRAIN"}
    return X.zone_series(spark, d).drop("day_of_week").withColumnsRenamed(names)


@query("flt_training_rows", "SELECT zone_id, count(*) AS rows, count(*) FILTER (load_kwh > 0 AND energy_price > 0.5) AS valid FROM zone_series GROUP BY zone_id", X.SERIES)
def training_rows(spark, d):
    return X.zone_series(spark, d).groupBy("zone_id").agg(F.count("*").alias("rows"), F.count_if((_C("load_kwh") > 0) & (_C("energy_price") > 0.5)).alias("valid"))


@query("src_long_format", "SELECT zone_id, timestamp, load_kwh, CAST(extract(hour FROM timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, CAST(isodow(timestamp) > 5 AS INTEGER) AS is_weekend, occupancy FROM zone_hourly", X.HOURLY, "occupancy")
def long_format(spark, d):
    raw = X.zone_hourly(spark, d).withColumnsRenamed({"zone_id": "ZONE", "load_kwh": "kwh", "timestamp": "time"})
    return P.calendar(P.aliased(raw, {"timestamp": ["time"], "zone_id": ["zone"], "load_kwh": ["kwh", "load"]}))


@query("join_load_price", "SELECT zone_id, timestamp, h.load_kwh, energy_price FROM zone_hourly h JOIN zone_series s USING (zone_id, timestamp)", X.SERIES)
def load_price(spark, d):
    return P.merged_series(X.zone_hourly(spark, d).select("zone_id", "timestamp", "load_kwh"), X.zone_series(spark, d).select("zone_id", "timestamp", "energy_price"))


@query("join_optional_series", "SELECT zone_id, timestamp, s.energy_price, s.service_price, h.occupancy FROM zone_series s LEFT JOIN zone_hourly h USING (zone_id, timestamp)", X.SERIES, "occupancy")
def optional_series(spark, d):
    s = X.zone_series(spark, d)
    return P.merged_series(s.select("zone_id", "timestamp", "energy_price"), s.select("zone_id", "timestamp", "service_price"), [X.zone_hourly(spark, d).select("zone_id", "timestamp", "occupancy")])


@query("join_weather", "SELECT zone_id, timestamp, load_kwh, w.temperature, w.humidity, w.rain FROM zone_hourly LEFT JOIN weather w USING (timestamp)", X.SERIES)
def join_weather(spark, d):
    return X.zone_hourly(spark, d).select("zone_id", "timestamp", "load_kwh").join(F.broadcast(X.weather(spark)), "timestamp", "left")


_KIND = "CASE primary_types WHEN 'food and beverage services' THEN 'food' WHEN 'business residence' THEN 'business' WHEN 'lifestyle services' THEN 'lifestyle' END"
_CENTROIDS = f"""{X.STATIONS}, centroids AS (SELECT *, row_number() OVER (ORDER BY zone_id) AS ordinal FROM (SELECT zone_id, avg(longitude) AS longitude, avg(latitude) AS latitude FROM stations GROUP BY zone_id))"""
_NEAR = """near AS (SELECT poi_id, primary_types, arg_min(c.zone_id, (({0} * (p.longitude - c.longitude)) ** 2 + (p.latitude - c.latitude) ** 2, ordinal)) AS zone_id FROM poi p CROSS JOIN centroids c GROUP BY ALL)"""


def _centroids(spark, d):
    from pyspark.sql import Window

    return A.station_profile(X.stations(spark, d)).select("zone_id", "longitude", "latitude").withColumn("ordinal", F.row_number().over(Window.orderBy("zone_id")).cast("long"))


@query("join_nearest_centroid", "SELECT zone_id, count(*) AS total, count(*) FILTER (contains(primary_types, 'food')) AS food, count(*) FILTER (contains(primary_types, 'business')) AS business, count(*) FILTER (contains(primary_types, 'lifestyle') OR contains(primary_types, 'services')) AS lifestyle FROM near GROUP BY zone_id", f"{_CENTROIDS}, {_NEAR.format('1')}")
def nearest(spark, d):
    points = X.poi(spark, d).withColumnRenamed("poi_id", "point_id")
    near = P.nearest_centroid(points, _centroids(spark, d)).join(points, "point_id")
    has = lambda w: _C("primary_types").contains(w)
    return near.groupBy("zone_id").agg(F.count("*").alias("total"), F.count_if(has("food")).alias("food"), F.count_if(has("business")).alias("business"), F.count_if(has("lifestyle") | has("services")).alias("lifestyle"))


@query("join_nearest_centroid_scaled", f"SELECT zone_id, count(*) FILTER (k = 'food') AS food, count(*) FILTER (k = 'business') AS business, count(*) FILTER (k = 'lifestyle') AS lifestyle FROM (SELECT zone_id, {_KIND} AS k FROM near) GROUP BY zone_id", f"{_CENTROIDS}, {_NEAR.format('cos(radians((SELECT avg(latitude) FROM centroids)))')}")
def nearest_scaled(spark, d):
    points = X.poi(spark, d).withColumnRenamed("poi_id", "point_id")
    near = P.nearest_centroid(points, _centroids(spark, d), scale_longitude=True).join(points, "point_id")
    kinds = F.create_map(*[F.lit(x) for x in ("food and beverage services", "food", "business residence", "business", "lifestyle services", "lifestyle")])
    return near.withColumn("kind", kinds[_C("primary_types")]).groupBy("zone_id").pivot("kind", ["food", "business", "lifestyle"]).agg(F.count(F.lit(1))).fillna(0)


_TARIFF = """tariff AS (SELECT m AS month, period, (CAST(p AS DOUBLE) + m % 3) / 100 AS energy_price, 0.3e0 AS service_price FROM (SELECT DISTINCT extract(month FROM o_orderdate) AS m FROM orders),
    (VALUES ('Off-Peak(22:00-06:00)', 40), ('Shoulder(06:00-08:00, 12:00-17:00)', 70), ('Peak(08:00-12:00, 17:00-22:00)', 110), ('Sharp(19:00-21:00)', 150)) AS t(period, p))"""
_TARIFF_HOURS = "SELECT month, hour, label, energy_price, service_price, false AS conflict FROM (SELECT *, lower(split_part(period, '(', 1)) AS label FROM tariff) t, (SELECT unnest(range(24)) AS hour) h WHERE CASE label WHEN 'off-peak' THEN hour >= 22 OR hour < 6 WHEN 'shoulder' THEN hour IN (6, 7, 12, 13, 14, 15, 16) WHEN 'sharp' THEN hour IN (19, 20) ELSE hour IN (8, 9, 10, 11, 17, 18, 21) END"


def _tariffs(spark, d):
    kinds = F.array(*[F.struct(F.lit(t).alias("period"), F.lit(p).alias("p")) for t, p in (("Off-Peak(22:00-06:00)", 40), ("Shoulder(06:00-08:00, 12:00-17:00)", 70), ("Peak(08:00-12:00, 17:00-22:00)", 110), ("Sharp(19:00-21:00)", 150))])
    months = X.table(spark, d, "orders").select(F.month("o_orderdate").alias("month")).distinct()
    return months.withColumn("k", F.explode(kinds)).select("month", "k.period", ((_C("k.p") + _C("month") % 3) / 100).alias("energy_price"), F.lit(0.3).alias("service_price"))


@query("fn_tou_expand", f"SELECT * REPLACE (CAST(month AS INTEGER) AS month, CAST(hour AS INTEGER) AS hour) FROM ({_TARIFF_HOURS})", _TARIFF)
def tou_expand(spark, d):
    return P.tariff_hours(_tariffs(spark, d))


@query("join_tariff", f"SELECT o_orderkey, t.label, t.energy_price FROM orders LEFT JOIN ({_TARIFF_HOURS}) t ON t.month = extract(month FROM o_orderdate) AND t.hour = o_orderkey % 24", _TARIFF)
def join_tariff(spark, d):
    hours = P.tariff_hours(_tariffs(spark, d)).select("month", "hour", "label", "energy_price")
    rows = X.table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"), (_C("o_orderkey") % 24).cast("int").alias("hour"))
    return rows.join(F.broadcast(hours), ["month", "hour"], "left").select("o_orderkey", "label", "energy_price")  # at most 12 x 24 rows


@query("agg_site_exclusion", "SELECT zone_id, CASE WHEN NOT p THEN 'invalid_price' ELSE 'invalid_energy' END AS reason FROM (SELECT zone_id, bool_and(energy_price > 0.48) AS p, bool_and(load_kwh >= 1) AS l FROM zone_series GROUP BY zone_id) WHERE NOT p OR NOT l", X.SERIES)
def site_exclusion(spark, d):
    s = X.zone_series(spark, d)
    return P.site_exclusions(s.withColumn("energy_price", _C("energy_price") - 0.48), s.withColumn("load_kwh", _C("load_kwh") - 1))


_WIN = f"wins AS (SELECT zone_id, window_start, window_start + INTERVAL 4 HOUR AS window_end, position, CASE WHEN position % 7 = 6 THEN -1 ELSE position / 10e0 END AS proposed FROM (SELECT zone_id, timestamp AS window_start, row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) AS position FROM zone_series WHERE timestamp >= {_O} AND hour % 3 = 0))"


def proposal_windows(spark, d):
    """Overlapping windows of five hours, one in seven with an invalid price."""
    from pyspark.sql import Window

    rows = X.zone_series(spark, d).where((_C("timestamp") >= origin()) & (_C("hour") % 3 == 0)).select("zone_id", _C("timestamp").alias("window_start"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("zone_id").orderBy("window_start")))
    return rows.withColumns({"window_end": _C("window_start") + F.expr("interval 4 hours"), "proposed_energy_price": F.when(_C("position") % 7 == 6, -1.0).otherwise(_C("position") / 10)})


@query("join_price_override", "SELECT zone_id, timestamp, coalesce(p, energy_price) AS energy_price FROM zone_series LEFT JOIN (SELECT s.zone_id, s.timestamp, arg_max(proposed, position) AS p FROM zone_series s JOIN wins w ON w.zone_id = s.zone_id AND s.timestamp BETWEEN window_start AND window_end WHERE proposed >= 0 GROUP BY ALL) USING (zone_id, timestamp)", f"{X.SERIES}, {_WIN}", "energy_price")
def price_override(spark, d):
    return P.price_override(X.zone_series(spark, d).select("zone_id", "timestamp", "energy_price"), proposal_windows(spark, d))


_SPANS = "SELECT zone_id, timestamp AS a, timestamp + INTERVAL 1 HOUR * (4 + extract(hour FROM timestamp) % 5) AS b FROM zone_hourly WHERE extract(day FROM timestamp) % 3 = 0 AND extract(hour FROM timestamp) % 4 = 0 UNION ALL SELECT DISTINCT zone_id, TIMESTAMP '2024-01-20', NULL FROM zone_hourly WHERE zone_id LIKE '%-2' UNION ALL SELECT DISTINCT zone_id, NULL, TIMESTAMP '2024-01-02' FROM zone_hourly WHERE zone_id LIKE '%-1'"


@query("join_training_overlap", f"SELECT h.zone_id, h.timestamp FROM zone_hourly h SEMI JOIN ({_SPANS}) i ON h.zone_id = i.zone_id AND (a IS NULL OR h.timestamp >= a) AND (b IS NULL OR h.timestamp < b)", X.HOURLY)
def training_overlap(spark, d):
    """Hours inside any training interval of their zone: many that overlap, some without an end."""
    rows = X.zone_hourly(spark, d).select("zone_id", "timestamp")
    day, hour, none = F.dayofmonth("timestamp"), F.hour("timestamp"), F.lit(None).cast("timestamp_ntz")
    short = rows.where((day % 3 == 0) & (hour % 4 == 0)).select("zone_id", _C("timestamp").alias("start"), (_C("timestamp") + F.make_dt_interval(hours=4 + hour % 5)).cast("timestamp_ntz").alias("end"))
    zones = rows.select("zone_id").distinct()
    late = zones.where("zone_id LIKE '%-2'").select("zone_id", F.lit("2024-01-20").cast("timestamp_ntz").alias("start"), none.alias("end"))
    early = zones.where("zone_id LIKE '%-1'").select("zone_id", none.alias("start"), F.lit("2024-01-02").cast("timestamp_ntz").alias("end"))
    return I.covered(rows, short.unionByName(late).unionByName(early), ["zone_id"], "timestamp")


@query("set_hour_grid", "SELECT z.zone_id, h.timestamp FROM (SELECT DISTINCT zone_id FROM zone_hourly) z CROSS JOIN hours h ANTI JOIN zone_hourly o ON o.zone_id = z.zone_id AND o.timestamp = h.timestamp", X.SERIES)
def hour_grid(spark, d):
    return A.missing_hours(X.zone_hourly(spark, d), X.hours(spark))


@query("set_zone_union", "SELECT zone_id FROM zone_hourly UNION SELECT zone_id FROM stations UNION SELECT 'excluded-' || r_name FROM region", f"{X.HOURLY}, {X.STATIONS}")
def zone_union(spark, d):
    more = X.table(spark, d, "region").select(F.concat(F.lit("excluded-"), "r_name").alias("zone_id"))
    return X.zone_hourly(spark, d).select("zone_id").union(X.stations(spark, d).select("zone_id")).union(more).distinct()

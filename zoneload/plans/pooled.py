"""A linear model over all zones: lags, calendar, covariates, a level per zone and per value of each categorical covariate."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

LAGS = ("lag_1", "lag_24")
CALENDAR = ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos")
#: Entries of the reduced system that the driver solves by itself; beyond, each step of the solution is a Spark job.
LOCAL_ENTRIES = 2_000_000


@dataclass
class Pooled:
    """Coefficients by term, levels by zone (zone_id, level) and by category (key ``column=value``, level), biases by zone
    (zone_id, bias: by hour ahead)."""

    coefficients: dict[str, float]
    covariates: Sequence[str]
    categories: Sequence[str]
    zones: DataFrame
    levels: DataFrame
    bias: DataFrame | None = field(default=None)


def calendar(time: str = "timestamp") -> dict[str, Column]:
    hour, day = F.hour(time) * (2 * math.pi / 24), F.weekday(time) * (2 * math.pi / 7)
    return dict(zip(CALENDAR, (F.sin(hour), F.cos(hour), F.sin(day), F.cos(day)), strict=True))


def _number(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def _keys(categories: Sequence[str]) -> Column:
    return F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in categories]).cast("array<string>")


def training_rows(series: DataFrame, covariates: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """zone_id, timestamp, load_kwh, x (intercept, lags, calendar, covariates) and the keys of the categories' values; rows
    without their own load or either lag are left out."""
    w = Window.partitionBy("zone_id").orderBy("timestamp")
    lags = [F.lag("load_kwh", n).over(w) for n in (1, 24)]
    x = F.array(F.lit(1.0), *lags, *calendar().values(), *[_number(c) for c in covariates])
    return series.select("zone_id", "timestamp", F.col("load_kwh").cast("double").alias("load_kwh"), x.alias("x"), _keys(categories).alias("keys")).where("load_kwh IS NOT NULL AND x[1] IS NOT NULL AND x[2] IS NOT NULL")


def _products(terms: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """By zone of a batch: sums of the products of all its columns, those of categories among what occurs there."""
        for batch in batches:
            for zone, group in batch.groupby("zone_id"):
                x, y = np.stack(group["x"].to_numpy()), group["load_kwh"].to_numpy()
                keys = np.stack(group["keys"].to_numpy()) if len(group["keys"].iloc[0]) else np.zeros((len(y), 0), object)
                known = sorted(set(keys.ravel().tolist()))
                hot = np.stack([(keys == k).any(1) for k in known], 1).astype(float) if known else np.zeros((len(y), 0))
                design = np.concatenate([x, hot], 1)
                gram = design.T @ design
                i, j = np.nonzero(gram)
                names = np.array([*terms, *known], object)
                yield pd.DataFrame({"zone_id": [zone], "n": [len(y)], "sy": [y.sum()], "k": [names.tolist()], "s": [design.sum(0)], "xy": [design.T @ y], "i": [names[i].tolist()], "j": [names[j].tolist()], "g": [gram[i, j]]})

    return run


def _solved(entries: DataFrame, right: dict[str, float], penalty: Mapping[str, float], start: float) -> dict[str, float]:
    """The solution of a symmetric positive system of (i, j, v) by conjugate gradients, scaled by its diagonal.

    The driver holds a few numbers per term. Up to ``LOCAL_ENTRIES`` entries it holds the matrix too; beyond, each product
    with it is a join and a sum in Spark.
    """
    names = sorted(right)
    place = {k: n for n, k in enumerate(names)}
    spark, count = entries.sparkSession, entries.count()
    ridge = np.array([penalty.get(k, start) for k in names])
    if count <= LOCAL_ENTRIES:
        table = entries.toPandas()
        rows, columns, values = table["i"].map(place).to_numpy(int), table["j"].map(place).to_numpy(int), table["v"].to_numpy()
        times = lambda v: np.bincount(rows, weights=values * v[columns], minlength=len(names))
        diagonal = np.bincount(rows, weights=np.where(rows == columns, values, 0.0), minlength=len(names))
    else:

        def times(v: np.ndarray) -> np.ndarray:
            vector = spark.createDataFrame([(k, float(x)) for k, x in zip(names, v, strict=True)], "j string, x double")
            out = np.zeros(len(names))
            for r in entries.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")).toLocalIterator():
                out[place[r["i"]]] = r["v"]
            return out

        diagonal = np.zeros(len(names))
        for r in entries.where("i = j").toLocalIterator():
            diagonal[place[r["i"]]] = r["v"]
    b = np.array([right[k] for k in names])
    scale = 1 / np.sqrt(np.maximum(diagonal + ridge, 1e-12))
    product = lambda v: scale * (times(scale * v) + ridge * scale * v)
    x, r = np.zeros(len(b)), scale * b
    p, size = r.copy(), float(r @ r)
    least = 1e-24 * max(size, 1e-300)
    for _ in range(20 * len(b) + 20):
        if size <= least:
            break
        q = product(p)
        step = size / float(p @ q)
        x, r = x + step * p, r - step * q
        p, size = r + (float(r @ r) / size) * p, float(r @ r)
    return dict(zip(names, (scale * x).tolist(), strict=True))


def fit(series: DataFrame, covariates: Sequence[str], categories: Sequence[str] = (), penalty: float = 1.0, validation: DataFrame | None = None) -> Pooled:
    """Ridge regression on one column per term, zone and category value; the intercept isn't penalised. Values of the
    categories are those that occur.

    Tasks send sums of products by zone. A zone's level meets no other zone's, so zones are eliminated; what is left is a
    sparse system of terms and category values that occur in some zone together, never a matrix of all levels. With a
    ``validation`` series (later hours), its residuals by hour ahead are kept as each zone's bias.
    """
    terms = ["intercept", *LAGS, *CALENDAR, *covariates]
    parts = checkpoint(training_rows(series, covariates, categories).mapInPandas(_products(terms), "zone_id string, n long, sy double, k array<string>, s array<double>, xy array<double>, i array<string>, j array<string>, g array<double>"))
    zones = parts.groupBy("zone_id").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    sums = parts.select("zone_id", F.inline(F.arrays_zip("k", "s", "xy"))).groupBy("zone_id", "k").agg(F.sum("s").alias("s"), F.sum("xy").alias("xy"))
    sums = checkpoint(sums.join(zones, "zone_id").withColumn("d", F.col("n") + F.lit(float(penalty))))
    whole = parts.select(F.inline(F.arrays_zip("i", "j", "g"))).groupBy("i", "j").agg(F.sum("g").alias("v"))
    other = sums.select("zone_id", F.col("k").alias("j"), F.col("s").alias("t"))
    taken = sums.select("zone_id", F.col("k").alias("i"), "s", "d").join(other, "zone_id").groupBy("i", "j").agg((-F.sum(F.col("s") * F.col("t") / F.col("d"))).alias("v"))
    entries = checkpoint(whole.unionByName(taken).groupBy("i", "j").agg(F.sum("v").alias("v")))
    right = {r["k"]: r["v"] for r in sums.groupBy("k").agg(F.sum(F.col("xy") - F.col("s") * F.col("sy") / F.col("d")).alias("v")).collect()}
    solved = _solved(entries, right, {"intercept": 1e-9}, float(penalty)) if right else {}
    coefficients = {t: solved.get(t, 0.0) for t in terms}
    spark = series.sparkSession
    value = spark.createDataFrame(list(solved.items()), "k string, b double")
    rest = sums.join(value, "k").groupBy("zone_id").agg(((F.first("sy") - F.sum(F.col("s") * F.col("b"))) / F.first("d")).alias("level"))
    levels = spark.createDataFrame([(k, v) for k, v in solved.items() if k not in coefficients], "key string, level double")
    model = Pooled(coefficients, list(covariates), list(categories), checkpoint(rest), levels)
    if validation is not None:
        model.bias = checkpoint(validation_bias(model, series, validation))
    return model


def predict(model: Pooled, history: DataFrame, future: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """zone_id, timestamp, offset (hours ahead, from 0), predicted_kwh: hour by hour, lags fed by own predictions, none below 0.

    ``schedule`` (zone_id, timestamp, energy_price) replaces prices. Zones run side by side; the recursion folds an array of
    each zone's hours ahead inside the JVM. Lag 24 falls back to lag 1, and both to 0, where there is no such past; zones and
    category values that the model doesn't know have no level.
    """
    if schedule is not None:
        future = future.drop("energy_price").join(schedule.select("zone_id", "timestamp", "energy_price"), ["zone_id", "timestamp"], "left")
    c = model.coefficients
    fixed = F.lit(c["intercept"]) + sum((F.lit(c[n]) * v for n, v in calendar().items()), F.lit(0.0)) + sum((F.lit(c[n]) * _number(n) for n in model.covariates), F.lit(0.0))
    rows = future.select("zone_id", "timestamp", fixed.alias("fixed"), _keys(model.categories).alias("keys"))
    if model.categories:
        own = rows.select("zone_id", "timestamp", F.explode("keys").alias("key")).join(model.levels, "key").groupBy("zone_id", "timestamp").agg(F.sum("level").alias("more"))
        rows = rows.join(own, ["zone_id", "timestamp"], "left").withColumn("fixed", F.col("fixed") + F.coalesce("more", F.lit(0.0)))
    recent = F.row_number().over(Window.partitionBy("zone_id").orderBy(F.desc("timestamp")))
    last = history.where("load_kwh IS NOT NULL").withColumn("__n", recent).where("__n <= 24").groupBy("zone_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", F.col("load_kwh").cast("double").alias("v")))), lambda r: r["v"]).alias("known"))
    ahead = rows.groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "fixed"))).alias("ahead"))
    ahead = ahead.join(last, "zone_id", "left").join(model.zones, "zone_id", "left")
    ahead = ahead.join(model.bias, "zone_id", "left") if model.bias is not None else ahead.withColumn("bias", F.lit(None).cast("array<double>"))
    none = F.array().cast("array<double>")
    ahead = ahead.withColumns({"known": F.coalesce("known", none), "bias": F.coalesce("bias", none), "level": F.coalesce("level", F.lit(0.0))})

    def hour(state: Column, row: Column) -> Column:
        known, done = state["known"], state["out"]
        back = F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit(0.0))
        day = F.coalesce(F.try_element_at(known, F.lit(-24)), back)
        bias = F.when(F.size("bias") > 0, F.get("bias", F.size(done) % F.size("bias"))).otherwise(0.0)
        value = F.greatest(F.lit(0.0), row["fixed"] + F.col("level") + F.lit(c["lag_1"]) * back + F.lit(c["lag_24"]) * day + bias)
        return F.struct(F.slice(F.concat(F.array(value), F.reverse(known)), 1, 24).alias("known"), F.concat(done, F.array(value)).alias("out"))

    # ``known`` is kept newest last; reversing twice keeps its latest 24 hours.
    def step(state: Column, row: Column) -> Column:
        nxt = hour(state, row)
        return F.struct(F.reverse(nxt["known"]).alias("known"), nxt["out"].alias("out"))

    folded = F.aggregate("ahead", F.struct(F.col("known").alias("known"), none.alias("out")), step, lambda s: s["out"])
    shown = ahead.withColumn("out", folded).select("zone_id", F.posexplode(F.arrays_zip(F.col("ahead.timestamp").alias("timestamp"), F.col("out").alias("predicted_kwh"))).alias("offset", "r"))
    return shown.select("zone_id", "r.timestamp", "offset", "r.predicted_kwh")


def validation_bias(model: Pooled, history: DataFrame, validation: DataFrame) -> DataFrame:
    """zone_id, bias: actual less predicted load of the validation hours, by hour ahead."""
    got = predict(model, history, validation).join(validation.select("zone_id", "timestamp", "load_kwh"), ["zone_id", "timestamp"]).where("load_kwh IS NOT NULL")
    residual = F.struct("offset", (F.col("load_kwh") - F.col("predicted_kwh")).alias("r"))
    return got.groupBy("zone_id").agg(F.transform(F.array_sort(F.collect_list(residual)), lambda x: x["r"]).alias("bias"))

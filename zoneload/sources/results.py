"""Saved control results of all schema versions, nested values under one set of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

VERSIONS = (2, 3, 4)
#: Names of older results and those that replace them.
RENAMED = {"forecast_start": "forecast_origin", "forecast_model": "backend"}

_WINDOW = "window_start: string, window_end: string, load_stress_level: string, mean_energy_price: double, baseline_price_valid: boolean, sum_predicted_kwh: double, reforecast_load_kwh: double, reforecast_load_stress_level: string, proposed_energy_price: double, price_valid: boolean, proposal_status: string, control_success: boolean"
#: The nested control result of one run.
CONTROL_SCHEMA = f"""schema_version int, status string, forecast_origin string, backend string, attempt_limit long, attempts_used long, batch string, mode string, validation_bias boolean, validation_days long, parameters map<string, string>,
    zones array<struct<zone_id: string, status: string, attempts_used: long, model_id: string, forecast_origin: string, backend: string,
        attempt_trace: array<struct<attempt: long, windows: array<struct<{_WINDOW}>>, calls: array<struct<agent: string, prompt_tokens: long, completion_tokens: long>>>>,
        final_windows: array<struct<{_WINDOW}>>>>"""
_MALFORMED = "__malformed"


def _old_names(new: str, renames: dict[str, str]) -> list[str]:
    return [old for old, name in renames.items() if name == new]


def accepting(kind: T.DataType, renames: dict[str, str] | None = None) -> T.DataType:
    """The type with the older names beside the newer ones, at any depth."""
    renames = RENAMED if renames is None else renames
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(accepting(kind.elementType, renames), kind.containsNull)
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, accepting(f.dataType, renames)) for f in kind]
        taken = {f.name for f in fields}
        return T.StructType(fields + [T.StructField(old, accepting(f.dataType, renames)) for f in kind for old in _old_names(f.name, renames) if old not in taken])
    return kind


def _one(new: Column, olds: dict[str, Column], name: str) -> Column:
    """The value under its new name; another one under an old name is an error."""
    for old, value in olds.items():
        differs = new.isNotNull() & value.isNotNull() & ~new.eqNullSafe(value)
        message = F.lit(f"conflicting fields of saved results: {old} and {name}")
        new = F.when(differs, F.raise_error(message)).otherwise(F.coalesce(new, value))
    return new


def _without(value: Column, *names: str) -> Column:
    return F.map_filter(value, lambda k, _: ~k.isin(*names))


def normalised(value: Column, kind: T.DataType, renames: dict[str, str] | None = None) -> Column:
    """A value of the type ``accepting(kind)`` as one of ``kind``: older names give way to newer ones in every struct and
    map, however deep; both with different values is an error, a null counts as absent. All in expressions, without parsing."""
    renames = RENAMED if renames is None else renames
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType, renames))
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind:
            olds = {old: normalised(value[old], f.dataType, renames) for old in _old_names(f.name, renames)}
            fields.append(_one(normalised(value[f.name], f.dataType, renames), olds, f.name).cast(f.dataType).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        for old, new in renames.items():
            one = _one(F.try_element_at(value, F.lit(new)), {old: F.try_element_at(value, F.lit(old))}, new).cast(kind.valueType)
            rest = _without(value, old, new)
            value = F.when(F.map_contains_key(value, old), F.map_concat(rest, F.create_map(F.lit(new), one))).otherwise(value)
        return value
    return value


def read_results(spark: SparkSession, path: str, schema: str = CONTROL_SCHEMA, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nested results below ``path`` and, apart, what couldn't be read (path, text).

    One run per line, or per file. ``run`` is the line's own field of that name or, where it has none, comes from
    ``run=...`` in its file's path, so that many runs may share a file. Versions other than 2 to 4 are an
    error, as are conflicting old and new names.
    """
    target = T.StructType.fromDDL(schema)
    own = [] if "run" in target.names else [T.StructField("run", T.StringType())]
    wide = T.StructType([*accepting(target).fields, *own, T.StructField(_MALFORMED, T.StringType())])
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", not lines).text(path)
    texts = files.select(F.regexp_replace("value", "^\ufeff", "").alias("text"), F.col("_metadata.file_path").alias("path")).where(F.trim("text") != "")
    # Exploded from an array of one, so that the filters below stay above and no text is parsed a second time for them.
    value = F.from_json("text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED})
    parsed = texts.select("text", "path", F.explode(F.array(value)).alias("r"))
    broken = F.col("r").isNull() | F.col(f"r.{_MALFORMED}").isNotNull()
    got = parsed.where(~broken).select(normalised(F.col("r"), target).alias("r"), F.coalesce(F.col("r.run").cast("string"), F.regexp_extract("path", r"run=([^/]+)", 1)).alias("__run")).select("r.*", "__run").drop("run").withColumnRenamed("__run", "run")
    version = F.col("schema_version")
    message = F.concat(F.lit("unknown schema version "), F.coalesce(version.cast("string"), F.lit("null")))
    checked = got.withColumn("schema_version", F.when(version.isin(*VERSIONS), version).otherwise(F.raise_error(message)))
    return checked, parsed.where(broken).select("path", "text")


def rounds_of(results: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows of nested results by round, and the final windows.

    Rounds (keys, zone_id, window_start, window_end, round, load_kwh, stress, price, control_success): 0 is the baseline,
    from the final window or, where that lacks it, the first attempt that has it; others are the attempts. Finals have
    the same columns with the run's status, rounds used and limit in place of the round. The run's rounds used are the
    largest of any zone or attempt where the run itself doesn't say. A repeated zone or attempt is an error. Zones are kept
    once, as rounds and finals are laid out from them in turn; the texts behind are parsed only then.
    """
    keys = ["run"] if keys is None else keys
    used = F.coalesce("attempts_used", F.array_max(F.transform("zones", lambda z: F.greatest(F.coalesce(z["attempts_used"], F.lit(0)), F.coalesce(F.array_max(z["attempt_trace"]["attempt"]), F.lit(0))))), F.lit(0))
    zone_ids = F.col("zones.zone_id")
    once = F.when(F.size(F.array_distinct(zone_ids)) < F.size(zone_ids), F.raise_error(F.lit("a zone is repeated in a result")).cast("long")).otherwise(used)
    runs = results.select(*keys, "status", once.alias("run_used"), F.coalesce("attempt_limit", F.lit(0)).alias("limit"), F.explode("zones").alias("z"))
    numbers = F.col("z.attempt_trace.attempt")
    zone_used = F.coalesce("z.attempts_used", F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), F.raise_error(F.lit("an attempt is repeated in a zone")).cast("long")).otherwise(F.col("run_used")))
    attempts = F.transform("z.attempt_trace", lambda a: F.struct(a["attempt"].alias("attempt"), a["windows"].alias("windows")))
    kept = F.struct(F.col("z.zone_id").alias("zone_id"), attempts.alias("attempt_trace"), F.col("z.final_windows").alias("final_windows"))
    zones = checkpoint(runs.select(*keys, "status", "run_used", "limit", zone_used.alias("zone_used"), kept.alias("z")))
    key = [*keys, "zone_id", "window_start", "window_end"]
    of = lambda w, later: [w["window_start"].alias("window_start"), w["window_end"].alias("window_end"), (w["reforecast_load_kwh"] if later else w["sum_predicted_kwh"]).alias("load_kwh"), (w["reforecast_load_stress_level"] if later else w["load_stress_level"]).alias("stress"), F.when(F.coalesce(w["price_valid" if later else "baseline_price_valid"], F.lit(True)), w["proposed_energy_price" if later else "mean_energy_price"]).alias("price"), (w["control_success"] if later else F.lit(None).cast("boolean")).alias("control_success")]
    told = [*keys, F.col("z.zone_id").alias("zone_id")]
    last = zones.select(*told, "status", F.col("zone_used").alias("attempts_used"), F.greatest("limit", "run_used").alias("attempt_limit"), F.explode("z.final_windows").alias("w"))
    finals = last.select(*keys, "zone_id", "status", "attempts_used", "attempt_limit", *of(F.col("w"), True))
    trace = zones.select(*told, F.explode("z.attempt_trace").alias("a")).where("a.attempt >= 1").select(*keys, "zone_id", F.col("a.attempt").alias("round"), F.explode("a.windows").alias("w"))
    attempts = trace.select(*keys, "zone_id", "round", *of(F.col("w"), True))
    # The final window counts as attempt 0, so that its baseline comes first.
    bases = last.select(*keys, "zone_id", F.lit(0).cast("long").alias("round"), *of(F.col("w"), False)).unionByName(trace.select(*keys, "zone_id", "round", *of(F.col("w"), False)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("round"))).alias(c)
    baseline = bases.groupBy(*key).agg(*[first(c) for c in ("load_kwh", "stress", "price", "control_success")]).withColumn("round", F.lit(0).cast("long"))
    return baseline.unionByName(attempts), finals

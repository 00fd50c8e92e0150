"""Metric text line by line: samples, labels and types by expressions, so that one scrape's lines spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: What a sample's name adds to its family's.
COMPONENTS = ("bucket", "sum", "count", "created", "total")
_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_QUOTED = r'"((?:[^"\\]++|\\["\\n])*+)"'
_PAIR = rf"([A-Za-z_][A-Za-z0-9_]*+)\s*+=\s*+{_QUOTED}\s*+"
_LABELS = rf"\{{\s*+(?:{_PAIR}(?:,\s*+|(?=\}})))*+\}}"
_SAMPLE = rf"^([A-Za-z_:][A-Za-z0-9_:]*+)({_LABELS})?+\s++([^\s#]++)(?:\s++[^\s#]++)?+\s*+(?:#.*+)?+$"
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
_TYPE = r"^#\s+TYPE\s+(\S+)\s+(\S+)$"


def _unescaped(value: Column) -> Column:
    """Two characters of an escape to one; pieces between escaped backslashes have no others."""
    part = lambda p: F.replace(F.replace(p, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(value, r"\\\\"), part), "\\")


def metric_lines(texts: DataFrame, column: str = "text", prefix: str = "", strict: bool = True) -> DataFrame:
    """The other columns and the samples of each metric text: line, name, labels, type, family, component, value, value_text.

    Types come from the same text's ``# TYPE`` lines (the last of a name counts), for the sample's name or for its family,
    which lacks the component's suffix; a ``created`` sample is a gauge. Values that aren't finite are null and stay as
    text. A time stamp and what follows # (an exemplar) are passed over. A malformed line, a malformed or repeated label,
    or a repeated series is an error; not ``strict``: a text with an error gives no sample. Lines without the prefix are
    passed over. The result's columns replace the table's own of those names.
    """
    names = ["line", "name", "labels", "type", "family", "component", "value", "value_text"]
    keys = [c for c in texts.columns if c != column and c.lower() not in names]
    own = F.struct(*keys) if keys else F.struct(F.lit(1).alias("__none"))
    # The number first, by itself: beside the generator it would count lines.
    whole = texts.select(F.monotonically_increasing_id().alias("id"), own.alias("own"), F.coalesce(column, F.lit("")).alias("text"))
    numbered = whole.select("id", "own", F.posexplode(F.split("text", _BREAKS)).alias("line", "raw"))
    stripped = numbered.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")
    # One text's lines leave the task that read it.
    lines = checkpoint(stripped.repartition("id", "line"))
    kinds = lines.where(F.col("raw").rlike(_TYPE)).select("id", "line", F.regexp_extract("raw", _TYPE, 1).alias("named"), F.regexp_extract("raw", _TYPE, 2).alias("kind"))
    kinds = kinds.groupBy("id", "named").agg(F.max_by("kind", "line").alias("kind"))
    raw = F.col("raw")
    found = lines.where(~raw.startswith("#") & raw.startswith(prefix)).withColumns({"name": F.regexp_extract(raw, _SAMPLE, 1), "block": F.regexp_extract(raw, _SAMPLE, 2), "value_text": F.regexp_extract(raw, _SAMPLE, 5)})
    pair = _PAIR.replace("\\", "\\\\").replace("'", "\\'")
    found = found.withColumns({"k": F.expr(f"regexp_extract_all(block, '{pair}', 1)"), "v": F.transform(F.expr(f"regexp_extract_all(block, '{pair}', 2)"), _unescaped)})
    error = F.when((F.col("name") == "") | ~F.col("value_text").rlike(_NUMBER), F.concat(F.lit("invalid metric line: "), raw)).when(F.size(F.array_distinct("k")) < F.size("k"), F.concat(F.lit("repeated label: "), raw))
    entries = F.array_sort(F.arrays_zip("k", "v"))
    series = found.withColumn("error", error).withColumn("series", F.when(F.col("error").isNull(), entries))
    once = series.groupBy("id", "name", "series", F.when(F.col("error").isNotNull(), F.col("line")).alias("bad")).agg(F.count("*").alias("n"), F.min(F.struct("line", "own", "k", "v", "value_text", "error", "raw")).alias("s")).select("id", "name", "n", "s.*")
    fault = F.coalesce("error", F.when(F.col("n") > 1, F.concat(F.lit("repeated series: "), raw)))
    if strict:
        kept = once.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))
    else:
        judged = checkpoint(once.withColumn("fault", fault))
        kept = judged.where("fault IS NULL").join(judged.where("fault IS NOT NULL").select("id").distinct(), "id", "left_anti")
    suffix = F.regexp_extract("name", rf"_({'|'.join(COMPONENTS)})$", 1)
    base = F.when(suffix != "", F.expr("substring(name, 1, length(name) - length(suffix) - 1)"))
    rows = kept.withColumn("suffix", suffix).withColumn("base", base)
    rows = rows.join(kinds.withColumnsRenamed({"named": "name", "kind": "own_kind"}), ["id", "name"], "left").join(kinds.withColumnsRenamed({"named": "base", "kind": "base_kind"}), ["id", "base"], "left")
    of_family = (F.coalesce("own_kind", F.lit("untyped")) == "untyped") & F.col("base_kind").isNotNull()
    value = F.regexp_replace("value_text", "(?i)^([+-]?)inf(inity)?$", "$1Infinity").cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    kind = F.when(of_family & (F.col("suffix") == "created"), "gauge").when(of_family, F.col("base_kind")).otherwise(F.coalesce("own_kind", F.lit("untyped")))
    shown = [F.col("own")[k].alias(k) for k in keys]
    return rows.select(
        *shown, "line", "name", F.map_from_arrays("k", "v").alias("labels"), kind.alias("type"), F.when(of_family, F.col("base")).otherwise(F.col("name")).alias("family"), F.when(of_family, F.col("suffix")).otherwise("").alias("component"), finite.alias("value"), "value_text",
    )

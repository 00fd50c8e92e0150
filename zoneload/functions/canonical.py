"""A canonical form of nested JSON values as rows, and signatures of decisions from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Keys that hold explanations, in lower case.
EXPLANATIONS = ("reasoning_summary", "forecast_summary", "price_rationale", "message_to_other_agents", "agreements", "disagreements", "revisions_from_prior_round")
_OPEN, _DONE = "array<struct<path: string, v: variant>>", "array<struct<path: string, value: string>>"
#: Levels that one plan opens.
LEVELS = 12
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _number(value: Column) -> Column:
    # Adding 0 turns -0 into 0.
    return F.concat(F.lit("n:"), F.format_string("%.6f", F.round(value, 6) + F.lit(0.0)))


def _leaf(kind: Column, value: Column) -> Column:
    """A scalar as text: numbers, also those written as text, to six places; other text without blanks at its ends."""
    text = F.trim(value.cast("string"))
    return (
        F.when(kind == "VOID", "z").when(kind == "BOOLEAN", F.concat(F.lit("b:"), text)).when(kind != "STRING", _number(F.try_variant_get(value, "$", "double")))
        .when(text.rlike(_NUMBER) & text.try_cast("double").isNotNull(), _number(text.try_cast("double"))).otherwise(F.concat(F.lit("s:"), text))
    )


def _depth(text: Column) -> Column:
    """The deepest nesting of brackets outside strings; of text that isn't JSON, any number."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    opens = lambda c, no: F.when(c.isin("{", "["), 1).otherwise(no)
    step = lambda s, c: F.struct((s["now"] + opens(c, -1)).alias("now"), F.greatest(s["most"], s["now"] + opens(c, 0)).alias("most"))
    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _opened(state: DataFrame, keys: Sequence[str], dropped: Sequence[str]) -> DataFrame:
    """One level: the values of ``open`` (path, v) become entries of ``done`` (path, value), what they hold is open next."""
    known = F.transform("open", lambda n: F.struct(n["path"].alias("path"), n["v"].alias("v"), F.try_variant_get(n["v"], "$", "map<string,variant>").alias("o"), F.try_variant_get(n["v"], "$", "array<variant>").alias("a")))
    name = lambda key: F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    below = lambda n, key, v: F.struct(F.concat(n["path"], F.lit("/"), key).alias("path"), v.alias("v"))
    shown = lambda n: F.when(n["o"].isNotNull(), "{").when(n["a"].isNotNull(), "[").otherwise(_leaf(F.schema_of_variant(n["v"]), n["v"]))
    entries = lambda n: F.filter(F.map_entries(n["o"]), lambda e: ~F.lower(F.trim(e["key"])).isin(*dropped)) if dropped else F.map_entries(n["o"])
    held = lambda n: F.when(n["o"].isNotNull(), F.transform(entries(n), lambda e: below(n, name(e["key"]), e["value"]))).when(
        n["a"].isNotNull(), F.transform(n["a"], lambda v, i: below(n, i.cast("string"), v))
    ).otherwise(F.array().cast(_OPEN))
    rows = state.withColumn("open", known)
    return rows.select(*keys, F.concat("done", F.transform("open", lambda n: F.struct(n["path"].alias("path"), shown(n).alias("value")))).alias("done"), F.flatten(F.transform("open", held)).alias("open"))


def _flattened(rows: DataFrame, keys: Sequence[str], text: str, dropped: Sequence[str]) -> DataFrame:
    """keys, done: each row with all entries of ``leaves`` in an array; nothing is grouped, so rows stay where they are.

    The rows are kept once, as their depth tells how many levels one plan opens: ``LEVELS`` at most, then what is
    open is kept and opened further.
    """
    kept = checkpoint(rows.select(*keys, F.col(text).alias("text")))
    v = F.try_parse_json("text")
    first = F.when(v.isNotNull(), F.array(F.struct(F.lit("").alias("path"), v.alias("v")))).otherwise(F.array().cast(_OPEN))
    broken = F.when(v.isNull() & F.col("text").isNotNull(), F.array(F.struct(F.lit("").alias("path"), F.concat(F.lit("?"), "text").alias("value")))).otherwise(F.array().cast(_DONE))
    left = (kept.agg(F.max(_depth(F.col("text")))).first()[0] or 0) + 1
    state = kept.select(*keys, broken.alias("done"), first.alias("open"))
    while True:
        for _ in range(min(left, LEVELS)):
            state = _opened(state, keys, dropped)
        left -= LEVELS
        if left <= 0:
            return state.drop("open")
        state = checkpoint(state)
        if state.where(F.size("open") > 0).isEmpty():
            return state.drop("open")


def leaves(rows: DataFrame, keys: Sequence[str], text: str, dropped: Sequence[str] = EXPLANATIONS) -> DataFrame:
    """keys, path, value: each container (``{`` or ``[``) and scalar of the JSON values, by its path; keys in ``dropped`` go
    with all below them, at any depth and in any case. Equal rows mean equal values, whatever the order of keys, 1 or 1.0, or
    blanks; text that isn't JSON has one row, ``?`` with the text.

    Values are read once as VARIANT and opened one level at a time within their row, as often as the deepest one needs.
    """
    return _flattened(rows, keys, text, dropped).select(*keys, F.inline("done"))


def decision_signatures(rows: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """keys, order, signature, converged: the digest of each row's decisions (JSON) without explanations, and whether it is
    that of the row before in ``order``. A row without decisions has no signature and converges with nothing."""
    lines = F.transform("done", lambda n: F.concat(n["path"], F.lit("="), n["value"]))
    digest = F.when(F.size("done") > 0, F.sha2(F.array_join(F.sort_array(lines), "\n"), 256))
    got = _flattened(rows, [*keys, order], text, EXPLANATIONS).select(*keys, order, digest.alias("signature"))
    before = F.lag("signature").over(Window.partitionBy(*keys).orderBy(order))
    return got.select(*keys, order, "signature", F.coalesce(F.col("signature") == before, F.lit(False)).alias("converged"))

"""Times, calendar, blending, intervals, errors and token counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def datetime_24h(text: Column, strict: bool = False) -> Column:
    """A wall-clock time; exactly 24:00 is the next midnight, and a zone behind it is passed over as in any other time.
    Other text is null, or fails if ``strict``."""
    plain = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    parts = F.split(F.translate(plain, "T", " "), " ")
    clock = F.regexp_replace(F.get(parts, F.lit(1)), "(Z|[+-][0-9:]+)$", "")
    fraction = F.split(clock, r"\.")
    whole = fraction[0].isin("24:00", "24:00:00") & ((F.size(fraction) == 1) | (fraction[0] == "24:00:00") & F.get(fraction, F.lit(1)).rlike("^0+$"))
    midnight = (F.size(parts) == 2) & F.coalesce(whole, F.lit(False))
    parsed = plain.cast("timestamp_ntz") if strict else plain.try_cast("timestamp_ntz")
    day = parts[0].cast("date") if strict else parts[0].try_cast("date")
    return F.when(midnight, F.date_add(day, 1).cast("timestamp_ntz")).otherwise(parsed)


def time_identity(text: Column) -> Column:
    """Times with a zone as UTC without one; other labels as they are."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    utc = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    return F.when(zoned, F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), text)).otherwise(text)


def cyclic(value: Column, period: int, name: str) -> dict[str, Column]:
    angle = value * (2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def blend(forecast: Column, diurnal: Column, alpha: Column) -> Column:
    return F.greatest(F.lit(0.0), (1 - alpha) * forecast + alpha * diurnal)


def rebuilt_interval(point: Column, q10: Column, q90: Column) -> dict[str, Column]:
    """The interval's width kept, centred on the point, its lower end 0 at least; null where anything is."""
    half = F.greatest(F.lit(0.0), q90 - q10) / 2
    known = point.isNotNull() & q10.isNotNull() & q90.isNotNull()
    return {"q10_kwh": F.when(known, F.least(point, F.greatest(F.lit(0.0), point - half))), "q90_kwh": F.when(known, F.greatest(point, point + half))}


def symmetric_interval(point: Column, half: Column) -> dict[str, Column]:
    low = F.when(half <= 0, point).otherwise(F.least(point, F.greatest(F.lit(0.0), point - half)))
    return {"q10_kwh": F.when(half.isNotNull(), low), "q90_kwh": F.when(half.isNotNull(), F.greatest(point, point + F.greatest(F.lit(0.0), half)))}


def error_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    error = actual - predicted
    return {"error_kwh": error, "abs_error_kwh": F.abs(error), "abs_pct_error": F.when(F.abs(actual) > 1e-9, F.try_divide(F.abs(error), F.abs(actual)) * 100)}


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0 or anything is unknown."""
    return F.coalesce(F.when(denominator != 0, F.try_divide(numerator, denominator)), F.lit(0.0))


def all_known(flag: Column) -> Column:
    """Aggregate: false if any is false, else null if any is null, else true."""
    return F.when(F.coalesce(F.bool_or(~flag), F.lit(False)), False).when(F.count_if(flag.isNull()) > 0, F.lit(None)).otherwise(True)


def any_known(flag: Column) -> Column:
    """Aggregate: true if any is true, else null if any is null, else false."""
    return F.when(F.coalesce(F.bool_or(flag), F.lit(False)), True).when(F.count_if(flag.isNull()) > 0, F.lit(None)).otherwise(False)


def cache_usage(prompt: Column, cached: Column, permitted: Column) -> dict[str, Column]:
    """Cached tokens of one call: unknown without, or beyond, the prompt's; a share only where complete."""
    usable = F.when(prompt.isNotNull() & (cached <= prompt), cached)
    complete = usable.isNotNull() & F.coalesce(permitted, F.lit(True))
    return {
        "cached_tokens": F.when(complete, usable),
        "known_cached_tokens": F.coalesce(usable, F.lit(0)).cast("long"),
        "cache_reported_call_count": complete.cast("long"),
        "cache_usage_complete": complete,
        "cache_hit_ratio": F.when(complete & (prompt > 0), F.try_divide(usable, prompt)),
    }

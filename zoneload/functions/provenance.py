"""What saved runs say of their parameters, data and token use, in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forecast_parameters(raw: Column) -> dict[str, Column]:
    """Columns of saved forecast parameters (JSON of older or newer names): alpha to 6 places, backend, the calibration days
    in effect (0 where the bias is off), and the ridge penalty, which other backends' parameters lose."""
    get = lambda p: F.get_json_object(raw, f"$.{p}")
    days = F.when(get("validation_bias").cast("boolean"), get("calibration_days").cast("long")).otherwise(0)
    return {
        "alpha": F.round(F.coalesce(get("alpha"), get("blend_alpha")).cast("double"), 6), "backend": get("backend"), "calibration_days": days,
        "ridge_penalty": F.when(get("backend") == "ridge", get("ridge_penalty").cast("long")),
    }


def dataset_identity(name: Column, path: Column, unit: Column) -> dict[str, Column]:
    """A dataset's name from its manifest, else from its file; its price unit; whether the manifest told."""
    return {"dataset": F.coalesce(name, F.regexp_extract(path, r"([^/]+)\.csv$", 1)), "price_unit": F.coalesce(unit, F.lit("unknown")), "from_manifest": name.isNotNull()}


def provider_usage(payload: Column) -> dict[str, Column]:
    """Tokens of a provider's payload: one prompt total, or three input parts that add up."""
    get = lambda p: F.get_json_object(payload, f"$.usage.{p}").cast("long")
    part = lambda p: F.coalesce(get(p), F.lit(0))
    prompt = F.coalesce(get("prompt_tokens"), get("input_tokens") + part("cache_read_input_tokens") + part("cache_creation_input_tokens"))
    completion = F.coalesce(get("completion_tokens"), get("output_tokens"))
    return {"prompt_tokens": prompt, "completion_tokens": completion, "cached_tokens": F.coalesce(get("prompt_tokens_details.cached_tokens"), get("cache_read_input_tokens")), "total_tokens": prompt + completion}

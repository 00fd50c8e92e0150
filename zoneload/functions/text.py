"""Small vectorised helpers for nested JSON text and user functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold hidden reasoning, in lower case.
HIDDEN = frozenset({"chain_of_thought", "chain-of-thought", "thoughts", "analysis", "reasoning"})


def _visible(value):
    if isinstance(value, dict):
        return {k: _visible(v) for k, v in value.items() if k.strip().lower() not in HIDDEN}
    return [_visible(v) for v in value] if isinstance(value, list) else value


def response_object(column: str | Column) -> Column:
    """The first JSON object of a text, in canonical form and without hidden reasoning; null without one."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(text: str | None) -> str | None:
            for found in re.finditer(r"\{", text or ""):
                try:
                    return json.dumps(_visible(decoder.raw_decode(text, found.start())[0]), sort_keys=True)
                except ValueError:
                    continue
            return None

        return texts.map(one)

    return parse(column)


def analyzed(records: DataFrame, function: Callable[[dict], dict] | None = None) -> DataFrame:
    """Run a user's function on each record (as a dict); its dict comes back as JSON. Anything else is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["record"]:
                got = {"status": "not_configured"} if function is None else function(json.loads(text))
                if not isinstance(got, dict):
                    raise TypeError("an analyzer returns a dict")
                found.append(json.dumps(got, sort_keys=True))
            yield pd.DataFrame({"record": batch["record"], "analysis": found})

    options = {"ignoreNullFields": "false"}
    return records.select(F.to_json(F.struct("*"), options).alias("record")).mapInPandas(run, "record string, analysis string")

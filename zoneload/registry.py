"""Registration of queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Both sides round alike: the small addend keeps halves from falling either way by the order of a sum.
PLACES, ADDEND = 6, 1e-9


def rounded(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + ADDEND, PLACES) for c in columns})


def query(name: str, sql: str | None = None, views: str = "", doubles: str = ""):
    """Register ``function(spark, sf_dir)``. ``views``: the oracle's shared WITH list; ``doubles``: the columns that
    both sides round to the same number of places."""
    columns = doubles.split()

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir), columns)
        if sql is not None:
            shown = ", ".join(f"round({c} + {ADDEND}, {PLACES}) AS {c}" for c in columns)
            chosen = f"* REPLACE ({shown})" if columns else "*"
            ORACLES[name] = f"{'WITH ' + views if views else ''} SELECT {chosen} FROM ({sql})"
        return function

    return register

"""All registered queries of the library and their DuckDB counterparts."""

from .catalog import control, evaluate, features, forecast, metrics, prepare, scalars, sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

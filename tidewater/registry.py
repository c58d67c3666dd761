"""All queries of the engine with their DuckDB oracles."""

from tidewater.queries import dashboards, live, models, relational, scalar  # noqa: F401  registers them
from tidewater.queries.base import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

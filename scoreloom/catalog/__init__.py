"""Named queries and their SQL twins."""

from scoreloom.catalog import mart, reporting, runs, streams, texts  # noqa: F401
from scoreloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

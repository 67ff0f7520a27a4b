"""Named queries over the supplied tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show."""
    return df.select(
        *(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes)
    )


def rounded_sql(sql: str, columns: str, places: int = 6) -> str:
    """The same for SQL text; the double columns are named, separated by spaces."""
    replaced = ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"

"""Row filters, guarded projections and quality fallbacks over the results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_time(timestamp: Column) -> Column:
    """Epoch seconds to a timestamp."""
    return F.timestamp_seconds(timestamp)


def filter_results(
    df: DataFrame,
    policies: Sequence[str] | None = None,
    benchmarks: Sequence[str] | None = None,
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Policies, suites and an inclusive date range; every test can reach the scan."""
    if policies is not None:
        df = df.where(F.col("policy_name").isin(list(policies)))
    if benchmarks is not None:
        df = df.where(F.col("benchmark").isin(list(benchmarks)))
    if dates is not None:
        first, last = (F.unix_seconds(F.to_timestamp(F.lit(day))) for day in dates)
        # Compared in epoch seconds, the stored form, so that file statistics can skip data.
        stamp = F.col("timestamp")
        df = df.where((stamp >= first.cast("double")) & (stamp < (last + 86400).cast("double")))
    return df


def slice_policy(df: DataFrame, policy: str) -> DataFrame:
    return df.where(F.col("policy_name") == policy)


def is_valid() -> Column:
    return F.col("policy_name").isNotNull() & F.col("benchmark").isNotNull()


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def succeeded(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull())


def failed(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNotNull())


def project_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def quality_column(df: DataFrame) -> Column:
    """rouge_l if the table has it, else f1, else 0; decided per table, not per row."""
    for name in ("rouge_l", "f1"):
        if name in df.columns:
            return F.col(name)
    return F.lit(0.0)


def round_display(column: Column, places: int) -> Column:
    """Round half to even on the scaled value."""
    return F.rint(column * 10**places) / 10**places


def format_number(column: Column, places: int) -> Column:
    """A number for display: thousands set off by commas, a fixed number of decimal places."""
    return F.format_number(column, places)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()

"""The staging projection: guarded suite columns, run date, family and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.filters import run_time
from scoreloom.plans.policies import FAMILIES
from scoreloom.schemas import RESULTS, SUITE_COLUMNS


def policy_category() -> Column:
    """Family by LIKE prefix; as in SQL, `_` matches any one character."""
    cases = " ".join(
        f"WHEN policy_name LIKE '{prefix}%' THEN '{label}'" for prefix, label in FAMILIES.items()
    )
    return F.expr(f"CASE {cases} ELSE 'Other' END")


# Tiers of a metric, best first, each with the limit a value must be beyond (on the
# given side); whatever is beyond no limit, NULL included, is in the last tier.
TIERS = {
    "latency_tier": ("first_token_latency", "<", {"Fast": 0.1, "Medium": 0.5, "Slow": None}),
    "throughput_tier": ("throughput", ">", {"High": 100, "Medium": 50, "Low": None}),
    "quality_tier": ("f1", ">", {"High": 0.8, "Medium": 0.6, "Low": None}),
}


def limits_missed(tier: str) -> str:
    """SQL for how many of a tier's limits a row misses, that is its place among the labels from 0."""
    column, side, limits = TIERS[tier]
    missed = (f"CAST(coalesce(NOT {column} {side} {x}, TRUE) AS INT)" for x in limits.values() if x is not None)
    return " + ".join(missed)


def _tier(tier: str) -> Column:
    labels = ", ".join(f"'{label}'" for label in TIERS[tier][2])
    return F.expr(f"get(array({labels}), {limits_missed(tier)})")


def latency_tier() -> Column:
    return _tier("latency_tier")


def throughput_tier() -> Column:
    return _tier("throughput_tier")


def quality_tier() -> Column:
    return _tier("quality_tier")


def suite_guard() -> list[Column]:
    """Suite columns, NULL on rows of another suite."""
    return [
        F.expr(f"IF(benchmark = '{suite}', {name}, NULL) AS {name}")
        for suite, names in SUITE_COLUMNS.items()
        for name in names
    ]


def stage_results(results: DataFrame) -> DataFrame:
    guarded = {name for names in SUITE_COLUMNS.values() for name in names}
    plain = [n for n in RESULTS.fieldNames() if n not in guarded and n != "error"]
    started = run_time(F.col("timestamp"))
    return results.select(
        *plain,
        *suite_guard(),
        F.to_date(started).alias("run_date"),
        F.hour(started).alias("run_hour"),
        policy_category().alias("policy_category"),
        latency_tier().alias("latency_tier"),
        throughput_tier().alias("throughput_tier"),
        quality_tier().alias("quality_tier"),
    )

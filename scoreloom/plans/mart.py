"""Per-policy statistics within each suite, rankings, efficiency and trade-off profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.percentiles import (
    Percentile,
    approximate_percentiles,
    exact_percentiles,
)

GROUP = ["policy_name", "policy_category", "benchmark"]

MEANS = (
    "first_token_latency avg_token_latency generation_time throughput exact_match f1 rouge_l "
    "semantic_similarity policy_overhead total_tokens prediction_length length_ratio"
).split()
SPREADS = ["first_token_latency", "throughput"]

PERCENTILES = [
    Percentile("p95_first_token_latency", "first_token_latency", 0.95),
    Percentile("p99_first_token_latency", "first_token_latency", 0.99),
    Percentile("p95_avg_token_latency", "avg_token_latency", 0.95),
    Percentile("p95_generation_time", "generation_time", 0.95),
    Percentile("p95_throughput", "throughput", 0.95),
    Percentile("p95_f1", "f1", 0.95),
    Percentile("p05_f1", "f1", 0.05),
]

STATS_ORDER = (
    "policy_name policy_category benchmark sample_count "
    "mean_first_token_latency p95_first_token_latency p99_first_token_latency "
    "min_first_token_latency max_first_token_latency std_first_token_latency "
    "mean_avg_token_latency p95_avg_token_latency mean_generation_time p95_generation_time "
    "mean_throughput p95_throughput min_throughput max_throughput std_throughput "
    "mean_exact_match mean_f1 mean_rouge_l mean_semantic_similarity p95_f1 p05_f1 "
    "mean_policy_overhead mean_total_tokens mean_prediction_length mean_length_ratio "
    "pct_fast_latency pct_high_throughput pct_high_quality "
    "mean_crm_keyword_coverage mean_worf_reasoning_depth "
    "first_run_date last_run_date run_days"
).split()


def share_of(column: str, value: str, name: str) -> Column:
    """Percentage of rows in one tier."""
    return F.expr(f"avg(IF({column} = '{value}', 100D, 0D)) AS {name}")


def plain_statistics() -> list[Column]:
    """Every statistic that merges from partial aggregates."""
    return [
        F.expr("count(*) AS sample_count"),
        *(F.expr(f"avg({c}) AS mean_{c}") for c in MEANS),
        *(
            F.expr(f"{function}({c}) AS {name}_{c}")
            for c in SPREADS
            for name, function in (("min", "min"), ("max", "max"), ("std", "stddev_samp"))
        ),
        share_of("latency_tier", "Fast", "pct_fast_latency"),
        share_of("throughput_tier", "High", "pct_high_throughput"),
        share_of("quality_tier", "High", "pct_high_quality"),
        F.expr("avg(IF(benchmark = 'crmarena', overall_keyword_coverage, NULL)) AS mean_crm_keyword_coverage"),
        F.expr("avg(IF(benchmark = 'worfbench', reasoning_depth, NULL)) AS mean_worf_reasoning_depth"),
        F.expr("min(run_date) AS first_run_date"),
        F.expr("max(run_date) AS last_run_date"),
        # Calendar days are few; a set of them merges map-side where DISTINCT would expand rows.
        F.expr("CAST(size(collect_set(run_date)) AS BIGINT) AS run_days"),
    ]


def policy_stats(staged: DataFrame, exact: bool = True, **options: int) -> DataFrame:
    """One row per policy and suite. exact=False trades rank error 1/accuracy for one scan less."""
    summarise = exact_percentiles if exact else approximate_percentiles
    stats = summarise(staged, GROUP, PERCENTILES, plain_statistics(), **options)
    return stats.select(*STATS_ORDER)


def rank_within_suite(order: str) -> str:
    """SQL row number within the suite; ties go to the policy that comes first by name."""
    return f"row_number() OVER (PARTITION BY benchmark ORDER BY {order}, policy_name)"


def percent_rank_within_suite(order: str) -> str:
    return f"percent_rank() OVER (PARTITION BY benchmark ORDER BY {order})"


def quartile_within_suite(column: str, p: float) -> str:
    return f"percentile({column}, {p}D) OVER (PARTITION BY benchmark)"


def with_efficiency(stats: DataFrame) -> DataFrame:
    """Ratios, the composite score, and the quartile test for good trade-offs."""
    fast = quartile_within_suite("mean_first_token_latency", 0.25)
    good = quartile_within_suite("mean_f1", 0.75)
    total = "mean_first_token_latency + mean_policy_overhead"
    return stats.selectExpr(
        "*",
        "try_divide(mean_throughput, mean_first_token_latency) AS throughput_latency_ratio",
        "try_divide(mean_f1, mean_first_token_latency) AS quality_latency_ratio",
        "try_divide(mean_f1, mean_policy_overhead) AS quality_overhead_ratio",
        f"try_divide(mean_f1 * mean_throughput, {total}) AS efficiency_score",
        f"coalesce(mean_first_token_latency <= {fast} AND mean_f1 >= {good}, FALSE) "
        "AS is_pareto_efficient",
    )


def efficiency_metrics(stats: DataFrame) -> DataFrame:
    """The efficiency columns alone, with the group keys."""
    added = [c for c in with_efficiency(stats).columns if c not in stats.columns]
    return with_efficiency(stats).select(*GROUP, *added)


def join_stats_efficiency(stats: DataFrame, efficiency: DataFrame) -> DataFrame:
    """Join both halves when they come from different tables."""
    return stats.join(efficiency.drop("policy_category"), ["policy_name", "benchmark"]).select(
        *stats.columns, *(c for c in efficiency.columns if c not in GROUP)
    )


def with_ranks(mart: DataFrame) -> DataFrame:
    latency = "mean_first_token_latency ASC NULLS LAST"
    rate, f1 = "mean_throughput DESC NULLS LAST", "mean_f1 DESC NULLS LAST"
    efficiency = "efficiency_score DESC NULLS LAST"
    return mart.selectExpr(
        "*",
        f"{rank_within_suite(latency)} AS latency_rank",
        f"{rank_within_suite(rate)} AS throughput_rank",
        f"{rank_within_suite(f1)} AS quality_rank",
        f"{rank_within_suite(efficiency)} AS efficiency_rank",
        f"{percent_rank_within_suite(latency)} AS latency_percentile",
        f"{percent_rank_within_suite(rate)} AS throughput_percentile",
        f"{percent_rank_within_suite(f1)} AS quality_percentile",
    )


# Profiles in order of preference, with the ranks that must be among the first LEADING.
LEADING = 3
PROFILES = {
    "Optimal": ("latency_rank", "quality_rank"),
    "Fast": ("latency_rank",),
    "High Quality": ("quality_rank",),
    "High Throughput": ("throughput_rank",),
    "Balanced": (),
}


def profile_sql() -> str:
    """The first profile all of whose ranks lead; the last asks for none."""
    asked = (
        f"CASE WHEN greatest(0, {', '.join(ranks)}) <= {LEADING} THEN '{label}' END" if ranks else f"'{label}'"
        for label, ranks in PROFILES.items()
    )
    return f"coalesce({', '.join(asked)})"


def performance_profile() -> Column:
    return F.expr(profile_sql())


def build_summary(stats: DataFrame, stamp: bool = True) -> DataFrame:
    """The summary mart: both halves come from one frame, so no self-join is needed."""
    mart = with_ranks(with_efficiency(stats)).withColumn(
        "performance_profile", performance_profile()
    )
    return mart.withColumn("summary_generated_at", F.current_timestamp()) if stamp else mart


def order_summary(mart: DataFrame) -> DataFrame:
    return mart.orderBy(
        F.col("benchmark").asc_nulls_last(),
        F.col("efficiency_score").desc_nulls_last(),
        F.col("policy_name"),
    )


def best_by(column: str, lowest: bool) -> Column:
    """Policy with the best value; among equals the first by name."""
    value = F.col(column) if lowest else -F.col(column)
    order = F.when(value.isNotNull(), F.struct(value.alias("v"), F.col("policy_name").alias("p")))
    return F.min_by("policy_name", order)


def benchmark_comparison(stats: DataFrame) -> DataFrame:
    """Per suite: averages over its policies, and the best policy by each criterion."""
    return stats.groupBy("benchmark").agg(
        F.avg("mean_first_token_latency").alias("benchmark_avg_latency"),
        F.avg("mean_throughput").alias("benchmark_avg_throughput"),
        F.avg("mean_f1").alias("benchmark_avg_quality"),
        best_by("mean_first_token_latency", True).alias("best_latency_policy"),
        best_by("mean_throughput", False).alias("best_throughput_policy"),
        best_by("mean_f1", False).alias("best_quality_policy"),
    )

"""Queries of the staging view, the summary mart and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.catalog import twins
from scoreloom.catalog.registry import query, rounded, rounded_sql
from scoreloom.operators import staging
from scoreloom.operators.percentiles import exact_percentiles
from scoreloom.plans import incremental, mart
from scoreloom.schemas import SUITE_COLUMNS
from scoreloom.session import scratch
from scoreloom.sources.results import materialize_table, materialize_view
from scoreloom.sources.tables import results

STAGED_DOUBLES = (
    "timestamp first_token_latency avg_token_latency generation_time policy_overhead throughput "
    "exact_match precision recall f1 rouge_1 rouge_2 rouge_l semantic_similarity length_ratio "
    + " ".join(name for names in SUITE_COLUMNS.values() for name in names)
)
SUMMARY_DOUBLES = f"{twins.STATS_DOUBLES} {twins.EFFICIENCY_DOUBLES} {twins.RANK_DOUBLES}"


def staged(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    return staging.stage_results(results(spark, sf_dir, heavy))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.policy_stats(staged(spark, sf_dir, heavy=True))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.build_summary(stats(spark, sf_dir), stamp=False)


def _means_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics the rankings need, without the percentile pass."""
    return staged(spark, sf_dir).groupBy(*mart.GROUP).agg(*mart.plain_statistics())


@query("bench_summary", rounded_sql(f"WITH {twins.SUMMARY} SELECT * FROM summary", SUMMARY_DOUBLES))
def bench_summary(spark, sf_dir):
    return rounded(summary(spark, sf_dir))


@query("stg_results", rounded_sql(f"WITH {twins.STAGED} SELECT * FROM staged", STAGED_DOUBLES))
def stg_results(spark, sf_dir):
    return rounded(staged(spark, sf_dir))


_GUARDED = [name for names in SUITE_COLUMNS.values() for name in names]


@query(
    "suite_guard",
    rounded_sql(
        f"WITH {twins.STAGED} SELECT sample_id, benchmark, {', '.join(_GUARDED)} FROM staged",
        " ".join(_GUARDED),
    ),
)
def suite_guard(spark, sf_dir):
    return rounded(
        results(spark, sf_dir).select("sample_id", "benchmark", *staging.suite_guard())
    )


def _tier(name: str, column) -> None:
    @query(name, f"WITH {twins.STAGED} SELECT sample_id, {name} FROM staged")
    def tier(spark, sf_dir):
        return results(spark, sf_dir).select("sample_id", column().alias(name))


_tier("policy_category", staging.policy_category)
_tier("latency_tier", staging.latency_tier)
_tier("throughput_tier", staging.throughput_tier)
_tier("quality_tier", staging.quality_tier)


@query("policy_stats", rounded_sql(f"WITH {twins.STATS} SELECT * FROM stats", twins.STATS_DOUBLES))
def policy_stats(spark, sf_dir):
    return rounded(stats(spark, sf_dir))


_PERCENTILES = " ".join(p.name for p in mart.PERCENTILES)


@query(
    "group_percentiles",
    rounded_sql(
        f"WITH {twins.STATS} SELECT policy_name, benchmark, {', '.join(_PERCENTILES.split())} FROM stats",
        _PERCENTILES,
    ),
)
def group_percentiles(spark, sf_dir):
    keys = ["policy_name", "benchmark"]
    return rounded(exact_percentiles(results(spark, sf_dir, heavy=True), keys, mart.PERCENTILES))


_SHARES = "pct_fast_latency pct_high_throughput pct_high_quality"


@query(
    "tier_shares",
    rounded_sql(
        f"WITH {twins.STATS} SELECT policy_name, benchmark, {', '.join(_SHARES.split())} FROM stats",
        _SHARES,
    ),
)
def tier_shares(spark, sf_dir):
    shares = [
        mart.share_of("latency_tier", "Fast", "pct_fast_latency"),
        mart.share_of("throughput_tier", "High", "pct_high_throughput"),
        mart.share_of("quality_tier", "High", "pct_high_quality"),
    ]
    return rounded(staged(spark, sf_dir).groupBy("policy_name", "benchmark").agg(*shares))


_CONDITIONAL = "mean_crm_keyword_coverage mean_worf_reasoning_depth"


@query(
    "conditional_avg",
    rounded_sql(
        f"WITH {twins.STATS} SELECT policy_name, benchmark, {', '.join(_CONDITIONAL.split())} FROM stats",
        _CONDITIONAL,
    ),
)
def conditional_avg(spark, sf_dir):
    return rounded(
        _means_only(spark, sf_dir).select("policy_name", "benchmark", *_CONDITIONAL.split())
    )


@query(
    "run_days",
    f"WITH {twins.STATS} SELECT policy_name, benchmark, first_run_date, last_run_date, run_days FROM stats",
)
def run_days(spark, sf_dir):
    columns = ["policy_name", "benchmark", "first_run_date", "last_run_date", "run_days"]
    return _means_only(spark, sf_dir).select(*columns)


@query(
    "benchmark_comparison",
    rounded_sql(
        f"""WITH {twins.STATS}
        SELECT benchmark, avg(mean_first_token_latency) AS benchmark_avg_latency,
          avg(mean_throughput) AS benchmark_avg_throughput, avg(mean_f1) AS benchmark_avg_quality,
          first(policy_name ORDER BY mean_first_token_latency, policy_name) AS best_latency_policy,
          first(policy_name ORDER BY mean_throughput DESC, policy_name) AS best_throughput_policy,
          first(policy_name ORDER BY mean_f1 DESC, policy_name) AS best_quality_policy
        FROM stats GROUP BY benchmark""",
        "benchmark_avg_latency benchmark_avg_throughput benchmark_avg_quality",
    ),
)
def benchmark_comparison(spark, sf_dir):
    return rounded(mart.benchmark_comparison(_means_only(spark, sf_dir)))


@query(
    "efficiency_metrics",
    rounded_sql(f"WITH {twins.EFFICIENCY} SELECT * FROM efficiency", twins.EFFICIENCY_DOUBLES),
)
def efficiency_metrics(spark, sf_dir):
    return rounded(mart.efficiency_metrics(_means_only(spark, sf_dir)))


@query(
    "join_stats_efficiency",
    rounded_sql(
        f"""WITH {twins.EFFICIENCY}
        SELECT s.*, e.* EXCLUDE (policy_name, policy_category, benchmark)
        FROM stats s JOIN efficiency e ON s.policy_name = e.policy_name AND s.benchmark = e.benchmark""",
        f"{twins.STATS_DOUBLES} {twins.EFFICIENCY_DOUBLES}",
    ),
)
def join_stats_efficiency(spark, sf_dir):
    left = stats(spark, sf_dir)
    return rounded(mart.join_stats_efficiency(left, mart.efficiency_metrics(left)))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.with_ranks(mart.with_efficiency(_means_only(spark, sf_dir)))


def _rank(name: str, column: str) -> None:
    @query(name, f"WITH {twins.SUMMARY} SELECT policy_name, benchmark, {column} FROM summary")
    def rank(spark, sf_dir):
        return _ranked(spark, sf_dir).select("policy_name", "benchmark", column)


_rank("rank_latency", "latency_rank")
_rank("rank_throughput", "throughput_rank")
_rank("rank_quality", "quality_rank")
_rank("rank_efficiency", "efficiency_rank")
_rank("is_pareto_efficient", "is_pareto_efficient")


@query(
    "percent_ranks",
    rounded_sql(
        f"WITH {twins.SUMMARY} SELECT policy_name, benchmark, "
        f"{', '.join(twins.RANK_DOUBLES.split())} FROM summary",
        twins.RANK_DOUBLES,
    ),
)
def percent_ranks(spark, sf_dir):
    columns = ["policy_name", "benchmark", *twins.RANK_DOUBLES.split()]
    return rounded(_ranked(spark, sf_dir).select(*columns))


@query(
    "cte_ranks",
    f"WITH {twins.SUMMARY} SELECT policy_name, benchmark, latency_rank, throughput_rank, quality_rank FROM summary",
)
def cte_ranks(spark, sf_dir):
    columns = ["policy_name", "benchmark", "latency_rank", "throughput_rank", "quality_rank"]
    return _ranked(spark, sf_dir).select(*columns)


@query(
    "window_percentile",
    rounded_sql(
        f"""WITH {twins.STATS}
        SELECT policy_name, benchmark,
          quantile_cont(mean_first_token_latency, 0.25) OVER (PARTITION BY benchmark) AS p25_latency,
          quantile_cont(mean_f1, 0.75) OVER (PARTITION BY benchmark) AS p75_f1
        FROM stats""",
        "p25_latency p75_f1",
    ),
)
def window_percentile(spark, sf_dir):
    return rounded(
        _means_only(spark, sf_dir).selectExpr(
            "policy_name",
            "benchmark",
            f"{mart.quartile_within_suite('mean_first_token_latency', 0.25)} AS p25_latency",
            f"{mart.quartile_within_suite('mean_f1', 0.75)} AS p75_f1",
        )
    )


@query(
    "performance_profile",
    f"WITH {twins.SUMMARY} SELECT policy_name, benchmark, performance_profile FROM summary",
)
def performance_profile(spark, sf_dir):
    return _ranked(spark, sf_dir).select(
        "policy_name", "benchmark", mart.performance_profile().alias("performance_profile")
    )


_ORDERED = "policy_name, benchmark, efficiency_score, performance_profile"


@query(
    "order_summary",
    rounded_sql(
        f"WITH {twins.SUMMARY} SELECT {_ORDERED} FROM summary "
        "ORDER BY benchmark, efficiency_score DESC NULLS LAST, policy_name",
        "efficiency_score",
    ),
)
def order_summary(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).withColumn("performance_profile", mart.performance_profile())
    return rounded(mart.order_summary(ranked).select(*_ORDERED.split(", ")))


@query(
    "materialize_view_table",
    rounded_sql(
        f"WITH {twins.SUMMARY} SELECT policy_name, benchmark, sample_count, efficiency_score, performance_profile FROM summary",
        "efficiency_score",
    ),
)
def materialize_view_table(spark, sf_dir):
    """Staging as a view, the mart as a table, read back by name."""
    view = materialize_view(staged(spark, sf_dir, heavy=True), "stg_benchmark_results")
    built = mart.build_summary(mart.policy_stats(view))
    saved = materialize_table(built, "bench_summary", scratch(spark, "bench_summary"))
    columns = ["policy_name", "benchmark", "sample_count", "efficiency_score"]
    return rounded(saved.select(*columns, "performance_profile"))


@query("incremental_mart", rounded_sql(f"WITH {twins.STATS} SELECT * FROM stats", twins.STATS_DOUBLES))
def incremental_mart(spark, sf_dir):
    """A year of runs at a time: facts of the years before 1998, then of those still missing, then their sum."""
    path = scratch(spark, "incremental")
    runs = staged(spark, sf_dir, heavy=True).withColumn(incremental.RUN, F.year("run_date").cast("string"))
    incremental.refresh(runs.where(F.col(incremental.RUN) < "1998"), path)
    incremental.refresh(runs, path)
    return rounded(incremental.merged_stats(spark, path))

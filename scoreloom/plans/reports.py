"""Reports over the results table and the summary mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.filters import filter_results, quality_column, run_time
from scoreloom.operators.numbering import first_per_group, number_rows
from scoreloom.operators.percentiles import Percentile, exact_percentiles
from scoreloom.plans.mart import best_by
from scoreloom.session import settle, small_side

PAIR = ["policy_name", "benchmark"]
HEADLINE = ["first_token_latency", "throughput", "rouge_l"]
NOT_METRICS = {
    "sample_id", "policy_name", "benchmark", "prompt", "response", "ground_truth", "timestamp",
}
RANKS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def means(columns: Sequence[str]) -> list[Column]:
    return [F.avg(c).alias(f"mean_{c}") for c in columns]


def short_summary(results: DataFrame) -> DataFrame:
    """Mean latency, throughput and quality with the 95th latency percentile."""
    wanted = [Percentile("p95_latency", "first_token_latency", 0.95)]
    extra = [
        F.avg("first_token_latency").alias("avg_latency"),
        F.avg("throughput").alias("avg_throughput"),
        F.avg("rouge_l").alias("avg_quality"),
    ]
    return exact_percentiles(results, PAIR, wanted, extra)


def performance_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(*PAIR).agg(*means(HEADLINE))


def performance_summary_counts(results: DataFrame) -> DataFrame:
    """Mean and number of non-NULL values per headline column."""
    counts = [F.count(c).alias(f"count_{c}") for c in HEADLINE]
    return results.groupBy(*PAIR).agg(*means(HEADLINE), *counts)


def performance_summary_samples(results: DataFrame) -> DataFrame:
    return results.groupBy(*PAIR).agg(F.count("sample_id").alias("samples"), *means(HEADLINE))


def policy_comparison(results: DataFrame) -> DataFrame:
    return results.groupBy("policy_name").agg(
        *means(["first_token_latency", "throughput", "f1", "rouge_l"])
    )


def best_performers(results: DataFrame) -> DataFrame:
    return policy_comparison(results).agg(
        best_by("mean_first_token_latency", True).alias("best_latency"),
        best_by("mean_throughput", False).alias("best_throughput"),
        best_by("mean_f1", False).alias("best_quality"),
    )


def best_values(results: DataFrame) -> DataFrame:
    return performance_summary(results).agg(
        F.min("mean_first_token_latency").alias("best_latency"),
        F.max("mean_throughput").alias("best_throughput"),
        F.max("mean_rouge_l").alias("best_quality"),
    )


def run_summary(run: DataFrame) -> DataFrame:
    """Row count and global means of one run; quality columns only if the run has them."""
    optional = [c for c in ("exact_match", "f1", "rouge_l") if c in run.columns]
    return run.agg(
        F.count("*").alias("total_samples"),
        *means(["first_token_latency", "throughput", *optional]),
    )


def kpi_delta(results: DataFrame, selected: Column) -> DataFrame:
    """Filtered indicators and their distance from the whole table, in one pass."""
    chosen = F.coalesce(selected, F.lit(False))
    outputs = []
    for column in ("first_token_latency", "throughput", "f1"):
        inside = F.avg(F.when(chosen, F.col(column)))
        outputs.append(inside.alias(f"avg_{column}"))
        outputs.append((inside - F.avg(column)).alias(f"delta_{column}"))
    count = F.count_if(chosen)
    return results.agg(
        *outputs,
        count.alias("total_samples"),
        (count - F.count("*")).alias("delta_samples"),
    )


def numeric_metrics(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in NOT_METRICS
    ]


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """mean, min, max, population std and count of every numeric metric, as rows.

    Values are unpivoted in place and combined map-side, so only one partial row
    per metric and task is shuffled; a single wide aggregate of all metrics would
    be too large to compile.
    """
    names = numeric_metrics(results)
    long = results.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(i).alias("place"), F.col(name).cast("double").alias("value"))
                    for i, name in enumerate(names)
                )
            )
        )
    )
    labels = F.array(*(F.lit(name) for name in names))
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("place")
        .agg(
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.stddev_pop("value").alias("std"),
            F.count("*").alias("count"),
        )
        .select(F.get(labels, F.col("place")).alias("metric"), "mean", "min", "max", "std", "count")
    )


def nearest_rank_percentiles(
    df: DataFrame, keys: Sequence[str], column: str, ranks: dict[str, float] = RANKS
) -> DataFrame:
    """Percentiles by floor index, one row per group and percentile."""
    wanted = [Percentile(name, column, p) for name, p in ranks.items()]
    wide = exact_percentiles(df, keys, wanted, interpolate=False)
    return wide.unpivot(list(keys), list(ranks), "percentile", "value").where(
        F.col("value").isNotNull()
    )


def _box_fences(results: DataFrame, column: str) -> DataFrame:
    wanted = [
        Percentile("q1", column, 0.25),
        Percentile("median", column, 0.5),
        Percentile("q3", column, 0.75),
    ]
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    boxes = exact_percentiles(results, ["policy_name"], wanted)
    return settle(
        boxes.withColumns({"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach})
    )


def box_stats(results: DataFrame, column: str = "throughput") -> DataFrame:
    """Quartiles, whiskers and number of outliers per policy (fences at 1.5 quartile ranges)."""
    boxes = _box_fences(results, column)
    value = F.col(column)
    low, high = value >= F.col("low_fence"), value <= F.col("high_fence")
    whiskers = (
        results.select("policy_name", column)
        .join(small_side(boxes), "policy_name")
        .groupBy("policy_name")
        .agg(
            F.min(F.when(low, value)).alias("whisker_low"),
            F.max(F.when(high, value)).alias("whisker_high"),
            F.count_if(~(low & high)).alias("outliers"),
        )
    )
    return boxes.join(whiskers, "policy_name").drop("low_fence", "high_fence")


def box_outliers(results: DataFrame, column: str = "throughput") -> DataFrame:
    """The rows beyond the fences."""
    boxes = small_side(_box_fences(results, column))
    joined = results.join(boxes, "policy_name")
    value = F.col(column)
    outside = (value < F.col("low_fence")) | (value > F.col("high_fence"))
    return joined.where(outside).select("sample_id", "policy_name", "benchmark", column)


def value_bounds(results: DataFrame) -> DataFrame:
    day = F.to_date(run_time(F.col("timestamp")))
    return results.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def uniqueness_report(results: DataFrame) -> DataFrame:
    """Distinct texts per column, compared by SHA-256 so that no text is shuffled.

    Half a digest, 16 bytes, and its column's number are a row of one exchange; that two of 10 ** 9 texts share
    it has a chance below 10 ** -20.
    """
    columns = {"prompt": "prompts", "response": "responses", "ground_truth": "ground_truths"}
    marks = [
        F.struct(F.lit(i).cast("byte").alias("place"), F.unhex(F.substring(F.sha2(c, 256), 1, 32)).alias("digest"))
        for i, c in enumerate(columns)
    ]
    distinct = results.select(F.inline(F.array(*marks))).where("digest IS NOT NULL").distinct()
    return distinct.agg(
        *(F.count_if(F.col("place") == i).alias(f"unique_{n}") for i, n in enumerate(columns.values()))
    )


def slo_scorecard(
    results: DataFrame,
    max_p95_latency: float = 2.0,
    min_throughput: float = 300.0,
    min_quality: float = 0.1,
    max_error_rate: float = 0.01,
) -> DataFrame:
    """Per policy: the four service targets, measured and judged."""
    extra = [
        F.avg("throughput").alias("avg_throughput"),
        F.avg("rouge_l").alias("avg_rouge_l"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"),
    ]
    wanted = [Percentile("p95_latency", "first_token_latency", 0.95)]
    measured = exact_percentiles(results, ["policy_name"], wanted, extra)
    return measured.withColumns(
        {
            "latency_ok": F.col("p95_latency") < max_p95_latency,
            "throughput_ok": F.col("avg_throughput") > min_throughput,
            "quality_ok": F.col("avg_rouge_l") > min_quality,
            "errors_ok": F.col("error_rate") < max_error_rate,
        }
    )


def run_trend(staged: DataFrame) -> DataFrame:
    """Headline means by run date and hour."""
    return staged.groupBy("run_date", "run_hour").agg(
        F.count("*").alias("samples"), *means([*HEADLINE, "f1"])
    )


def policy_benchmark_pivot(
    results: DataFrame, suites: Sequence[str], column: str = "f1"
) -> DataFrame:
    """Policy by suite matrix of means; naming the suites saves a scan."""
    return results.groupBy("policy_name").pivot("benchmark", list(suites)).agg(F.avg(column))


def radar_scores(mart: DataFrame, policies: Sequence[str] | None = None) -> DataFrame:
    """Four scores in 0..1 per policy, from its first suite by name."""
    mart = filter_results(mart, policies)
    metrics = {
        "latency_score": "mean_first_token_latency",
        "throughput_score": "mean_throughput",
        "f1_score": "mean_f1",
        "rouge_l_score": "mean_rouge_l",
    }
    present = [c for c in metrics.values() if c in mart.columns]
    first = mart.groupBy("policy_name").agg(
        F.min_by(F.struct(*present), F.col("benchmark")).alias("row")
    )

    def score(name: str) -> Column:
        if name not in present:
            return F.lit(0.0)
        value = F.col("row")[name]
        if name == "mean_first_token_latency":
            return F.when(value > 0, 1 / (1 + value)).otherwise(F.lit(1.0))
        return F.when(value > 1, 1.0).otherwise(value)

    return first.select("policy_name", *(score(c).alias(n) for n, c in metrics.items()))


def scatter_projection(results: DataFrame) -> DataFrame:
    return results.select(
        "sample_id",
        "policy_name",
        F.col("first_token_latency").alias("latency"),
        quality_column(results).alias("quality"),
        "throughput",
        (F.col("throughput") / 20).alias("marker_size"),
    )


def top_efficiency(mart: DataFrame, n: int = 10) -> DataFrame:
    order = [F.col("efficiency_score").desc(), F.col("policy_name"), F.col("benchmark")]
    return mart.where(F.col("efficiency_score").isNotNull()).orderBy(*order).limit(n)


def head_rows(results: DataFrame, n: int = 50) -> DataFrame:
    return results.orderBy("sample_id").limit(n)


def limit_per_source(jobs: DataFrame, suite: str, job_id: str, n: int = 500) -> DataFrame:
    """At most n jobs of each suite, the first by id."""
    return first_per_group(jobs, [suite], [job_id], n)


def sample_sequence(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running number within policy and suite, and the id made of it."""
    numbered = number_rows(results, PAIR, order, "sample_number")
    number = F.col("sample_number").cast("string")
    padded = F.when(F.col("sample_number") < 10000, F.lpad(number, 4, "0")).otherwise(number)
    return numbered.withColumn(
        "sequence_id", F.concat_ws("_", "policy_name", "benchmark", padded)
    )

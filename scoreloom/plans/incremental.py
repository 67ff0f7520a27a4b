"""Policy statistics kept up to date from new runs alone.

A run leaves two small tables of facts: for each policy and suite its counts, sums, squared
deviations, extremes and days, and how often each value of the percentile columns stands. Facts
of several runs add up, so the statistics of all runs are read off them, percentiles included and exact,
and a run's rows are looked at once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.operators.percentiles import _ranks, percentile_columns, ranked_values
from scoreloom.plans.mart import GROUP, MEANS, PERCENTILES, SPREADS, STATS_ORDER
from scoreloom.session import settle

RUN = "run"
# Tables of facts under the mart's folder. Values come first: a run is known once its sums are there.
VALUES, SUMS = "values", "sums"

SHARES = {
    "pct_fast_latency": "latency_tier = 'Fast'",
    "pct_high_throughput": "throughput_tier = 'High'",
    "pct_high_quality": "quality_tier = 'High'",
}
INSIDE = {
    "mean_crm_keyword_coverage": ("crmarena", "overall_keyword_coverage"),
    "mean_worf_reasoning_depth": ("worfbench", "reasoning_depth"),
}
COLUMNS = list(dict.fromkeys(w.column for w in PERCENTILES))


def run_sums(staged: DataFrame) -> DataFrame:
    """One row per run, policy and suite, from staged results with a column `run`."""
    inside = {name: F.expr(f"IF(benchmark = '{suite}', {column}, NULL)") for name, (suite, column) in INSIDE.items()}
    return staged.groupBy(RUN, *GROUP).agg(
        F.count("*").alias("rows"),
        *(F.count(c).alias(f"count_{c}") for c in MEANS),
        *(F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in MEANS),
        *(F.min(c).alias(f"min_{c}") for c in SPREADS),
        *(F.max(c).alias(f"max_{c}") for c in SPREADS),
        *((F.var_pop(c) * F.count(c)).alias(f"squares_{c}") for c in SPREADS),
        *(F.expr(f"count_if({condition}) AS count_{name}") for name, condition in SHARES.items()),
        *(F.count(value).alias(f"count_{name}") for name, value in inside.items()),
        *(F.sum(value).alias(f"sum_{name}") for name, value in inside.items()),
        # Calendar days are few.
        F.collect_set("run_date").alias("days"),
    )


def run_values(staged: DataFrame) -> DataFrame:
    """(run, group, place, value, copies) of every percentile column; place is the column's number."""
    values = ", ".join(f"struct({i} AS place, CAST({c} AS DOUBLE) AS value)" for i, c in enumerate(COLUMNS))
    long = staged.selectExpr(RUN, *GROUP, f"inline(array({values}))").where("value IS NOT NULL")
    return long.groupBy(RUN, *GROUP, "place", "value").agg(F.count("*").alias("copies"))


def known_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The runs whose facts are stored, from the names of their folders; None where nothing is stored yet."""
    try:
        return spark.read.schema(f"{RUN} string").parquet(f"{path}/{SUMS}").distinct()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _store(facts: DataFrame, path: str) -> None:
    """Only the folders of the runs at hand are replaced, so a refresh that failed can be done again."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def refresh(staged: DataFrame, path: str) -> None:
    """Add the facts of every run that is not known yet.

    staged has a string column `run`. A stored run is a closed one: its rows are neither read again nor
    replaced. Filters on `run` reach the scan where the results are partitioned by it.
    """
    known = known_runs(staged.sparkSession, path)
    fresh = staged if known is None else staged.join(F.broadcast(known), RUN, "left_anti")
    _store(run_values(fresh), f"{path}/{VALUES}")
    _store(run_sums(fresh), f"{path}/{SUMS}")


def merged_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of all stored runs, column for column those of `policy_stats`."""
    sums = spark.read.parquet(f"{path}/{SUMS}")
    group = F.struct(*GROUP).alias("_group")
    all_runs = Window.partitionBy(*GROUP)
    off = {
        # How far a run's mean is from that of all runs, squared and weighted, adds to its own squares.
        f"_off_{c}": F.coalesce(F.col(f"squares_{c}"), F.lit(0.0))
        + F.coalesce(
            F.col(f"count_{c}")
            * F.pow(
                F.try_divide(f"sum_{c}", f"count_{c}")
                - F.try_divide(F.sum(f"sum_{c}").over(all_runs), F.sum(f"count_{c}").over(all_runs)),
                2,
            ),
            F.lit(0.0),
        )
        for c in SPREADS
    }
    total = lambda name: F.sum(f"count_{name}")
    stats = settle(
        sums.withColumns(off)
        .groupBy(*GROUP)
        .agg(
            F.sum("rows").alias("sample_count"),
            *(F.try_divide(F.sum(f"sum_{c}"), total(c)).alias(f"mean_{c}") for c in MEANS),
            *(F.min(f"min_{c}").alias(f"min_{c}") for c in SPREADS),
            *(F.max(f"max_{c}").alias(f"max_{c}") for c in SPREADS),
            *(F.sqrt(F.try_divide(F.sum(f"_off_{c}"), total(c) - 1)).alias(f"std_{c}") for c in SPREADS),
            *((100 * total(name) / F.sum("rows")).alias(name) for name in SHARES),
            *(F.try_divide(F.sum(f"sum_{name}"), total(name)).alias(name) for name in INSIDE),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("_days"),
            *(total(c).alias(f"_n_{c}") for c in COLUMNS),
        )
        .withColumns(
            {
                "first_run_date": F.try_element_at("_days", F.lit(1)),
                "last_run_date": F.try_element_at("_days", F.lit(-1)),
                "run_days": F.size("_days").cast("long"),
                "_group": group,
                "_gid": F.monotonically_increasing_id(),
            }
        )
    )
    wants = F.array(*(F.array(*(F.lit(i) for i, w in enumerate(PERCENTILES) if w.column == c)) for c in COLUMNS))
    values = settle(
        spark.read.parquet(f"{path}/{VALUES}")
        .select(group, "place", "value", "copies")
        .join(F.broadcast(stats.select("_group", "_gid")), "_group")
        .groupBy("_gid", "place", "value")
        .agg(F.sum("copies").alias("copies"))
        .select("_gid", F.explode(F.get(wants, F.col("place"))).alias("want"), "value", "copies")
    )
    targets = stats.selectExpr("_gid", f"inline({_ranks(PERCENTILES)})", "0L AS skip").where("n > 0").drop("n")
    found = ranked_values(values, targets)
    return percentile_columns(stats, found, PERCENTILES).select(*STATS_ORDER)

"""Queries of the filters and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.catalog import twins
from scoreloom.catalog.mart import _means_only, _ranked, staged
from scoreloom.catalog.registry import query, rounded, rounded_sql
from scoreloom.functions import registry
from scoreloom.operators import filters
from scoreloom.operators.filters import run_time
from scoreloom.plans import reports
from scoreloom.plans.policies import POLICIES
from scoreloom.session import scratch
from scoreloom.sources.results import append_results, scan_open_results, union_runs
from scoreloom.sources.tables import results

FIRST_FIVE = [p.name for p in POLICIES[:5]]
SUITES = ["crmarena", "worfbench"]
_IN = ", ".join(f"'{name}'" for name in FIRST_FIVE)


def _from_results(select: str, doubles: str = "") -> str:
    joint = "" if select.startswith(",") else " "
    sql = f"WITH {twins.RESULTS}{joint}{select}"
    return rounded_sql(sql, doubles) if doubles else sql


@query(
    "filter_policies_benchmarks",
    _from_results(
        f"""SELECT sample_id, policy_name, benchmark, f1 FROM results
        WHERE policy_name IN ({_IN}) AND benchmark IN ('crmarena', 'worfbench')""",
        "f1",
    ),
)
def filter_policies_benchmarks(spark, sf_dir):
    chosen = filters.filter_results(results(spark, sf_dir), FIRST_FIVE, SUITES)
    return rounded(chosen.select("sample_id", "policy_name", "benchmark", "f1"))


@query(
    "filter_date_range",
    _from_results(
        """SELECT sample_id, timestamp FROM results
        WHERE CAST(to_timestamp(timestamp) AT TIME ZONE 'UTC' AS DATE)
              BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
        "timestamp",
    ),
)
def filter_date_range(spark, sf_dir):
    dates = ("1996-01-01", "1998-12-31")
    chosen = filters.filter_results(results(spark, sf_dir), dates=dates)
    return rounded(chosen.select("sample_id", "timestamp"))


@query(
    "slice_policy",
    _from_results(
        f"""SELECT sample_id, policy_name, throughput FROM results
        WHERE policy_name = '{FIRST_FIVE[4]}'""",
        "throughput",
    ),
)
def slice_policy(spark, sf_dir):
    chosen = filters.slice_policy(results(spark, sf_dir), FIRST_FIVE[4])
    return rounded(chosen.select("sample_id", "policy_name", "throughput"))


@query(
    "valid_rows",
    _from_results("SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid FROM results"),
)
def valid_rows(spark, sf_dir):
    """Failed samples carry no policy, as in a table written without typed failures."""
    rows = results(spark, sf_dir)
    blank = rows.withColumn("policy_name", F.when(F.col("error").isNull(), F.col("policy_name")))
    return blank.agg(F.count("*").alias("total"), F.count_if(filters.is_valid()).alias("valid"))


@query(
    "split_errors",
    _from_results(
        """SELECT policy_name, benchmark, count(*) FILTER (error IS NULL) AS ok,
        count(*) FILTER (error IS NOT NULL) AS failed, count(*) AS total
        FROM results GROUP BY policy_name, benchmark"""
    ),
)
def split_errors(spark, sf_dir):
    rows = results(spark, sf_dir).select("policy_name", "benchmark", "error")
    return rows.groupBy("policy_name", "benchmark").agg(
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count("*").alias("total"),
    )


_DISPLAY = "sample_id policy_name benchmark first_token_latency throughput f1 exact_match rouge_l"


@query(
    "project_available",
    _from_results(
        f"SELECT {', '.join(_DISPLAY.split())} FROM results",
        "first_token_latency throughput f1 exact_match rouge_l",
    ),
)
def project_available(spark, sf_dir):
    columns = [*_DISPLAY.split(), "not_there"]
    return rounded(filters.project_available(results(spark, sf_dir), columns))


@query(
    "quality_fallback",
    _from_results(
        "SELECT sample_id, rouge_l AS quality, f1 AS quality_without_rouge FROM results",
        "quality quality_without_rouge",
    ),
)
def quality_fallback(spark, sf_dir):
    rows = results(spark, sf_dir)
    without = filters.quality_column(rows.drop("rouge_l"))
    return rounded(
        rows.select(
            "sample_id",
            filters.quality_column(rows).alias("quality"),
            without.alias("quality_without_rouge"),
        )
    )


@query(
    "round_display",
    _from_results(
        """SELECT sample_id, round_even(first_token_latency * 1000, 0) / 1000 AS latency_3,
        round_even(rouge_l * 10000, 0) / 10000 AS rouge_l_4 FROM results"""
    ),
)
def round_display(spark, sf_dir):
    return results(spark, sf_dir).select(
        "sample_id",
        filters.round_display(F.col("first_token_latency"), 3).alias("latency_3"),
        filters.round_display(F.col("rouge_l"), 4).alias("rouge_l_4"),
    )


@query(
    "scatter_projection",
    _from_results(
        """SELECT sample_id, policy_name, first_token_latency AS latency, rouge_l AS quality,
        throughput, throughput / 20 AS marker_size FROM results""",
        "latency quality throughput marker_size",
    ),
)
def scatter_projection(spark, sf_dir):
    return rounded(reports.scatter_projection(results(spark, sf_dir)))


@query("distinct_values", _from_results("SELECT DISTINCT prompt FROM results"))
def distinct_values(spark, sf_dir):
    return filters.distinct_values(results(spark, sf_dir), "prompt")


def _grouped(
    name: str, build, keys: str, columns: dict[str, str], counts: str = "", heavy: bool = False
) -> None:
    """A plain group-by report and its twin."""
    aggregates = ", ".join(f"{sql} AS {column}" for column, sql in columns.items())
    tail = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    doubles = " ".join(c for c in columns if c not in counts.split())

    @query(name, _from_results(f"SELECT {head}{aggregates} FROM results {tail}", doubles))
    def report(spark, sf_dir):
        return rounded(build(results(spark, sf_dir, heavy)))


_PAIR = "policy_name, benchmark"
_AVG = {f"mean_{c}": f"avg({c})" for c in reports.HEADLINE}
_grouped(
    "readme_summary",
    reports.short_summary,
    _PAIR,
    {
        "avg_latency": "avg(first_token_latency)",
        "p95_latency": "quantile_cont(first_token_latency, 0.95)",
        "avg_throughput": "avg(throughput)",
        "avg_quality": "avg(rouge_l)",
    },
    heavy=True,
)
_grouped("perf_summary", reports.performance_summary, _PAIR, _AVG)
_COUNTS = {f"count_{c}": f"count({c})" for c in reports.HEADLINE}
_grouped(
    "perf_summary_mean_count",
    reports.performance_summary_counts,
    _PAIR,
    _AVG | _COUNTS,
    " ".join(_COUNTS),
)
_grouped(
    "perf_summary_samples",
    reports.performance_summary_samples,
    _PAIR,
    {"samples": "count(sample_id)"} | _AVG,
    "samples",
)
_FOUR = {f"mean_{c}": f"avg({c})" for c in ("first_token_latency", "throughput", "f1", "rouge_l")}
_grouped("policy_comparison", reports.policy_comparison, "policy_name", _FOUR)
_grouped(
    "run_summary",
    reports.run_summary,
    "",
    {"total_samples": "count(*)", "mean_exact_match": "avg(exact_match)"} | _FOUR,
    "total_samples",
)

_BY_POLICY = ", ".join(f"{sql} AS {name}" for name, sql in _FOUR.items())


@query(
    "best_performers",
    _from_results(
        f""", means AS (SELECT policy_name, {_BY_POLICY} FROM results GROUP BY policy_name)
        SELECT first(policy_name ORDER BY mean_first_token_latency, policy_name) AS best_latency,
          first(policy_name ORDER BY mean_throughput DESC, policy_name) AS best_throughput,
          first(policy_name ORDER BY mean_f1 DESC, policy_name) AS best_quality FROM means"""
    ),
)
def best_performers(spark, sf_dir):
    return reports.best_performers(results(spark, sf_dir))


@query(
    "best_values",
    _from_results(
        """, means AS (SELECT avg(first_token_latency) AS l, avg(throughput) AS t, avg(rouge_l) AS q
                       FROM results GROUP BY policy_name, benchmark)
        SELECT min(l) AS best_latency, max(t) AS best_throughput, max(q) AS best_quality FROM means""",
        "best_latency best_throughput best_quality",
    ),
)
def best_values(spark, sf_dir):
    return rounded(reports.best_values(results(spark, sf_dir)))


_SELECTED = f"policy_name IN ({_IN})"
_KPI = ", ".join(
    f"avg({c}) FILTER ({_SELECTED}) AS avg_{c}, avg({c}) FILTER ({_SELECTED}) - avg({c}) AS delta_{c}"
    for c in ("first_token_latency", "throughput", "f1")
)


@query(
    "kpi_delta",
    _from_results(
        f"""SELECT {_KPI}, count(*) FILTER ({_SELECTED}) AS total_samples,
        count(*) FILTER ({_SELECTED}) - count(*) AS delta_samples FROM results""",
        "avg_first_token_latency delta_first_token_latency avg_throughput delta_throughput avg_f1 delta_f1",
    ),
)
def kpi_delta(spark, sf_dir):
    selected = F.col("policy_name").isin(FIRST_FIVE)
    return rounded(reports.kpi_delta(results(spark, sf_dir), selected))


_METRICS = (
    "first_token_latency avg_token_latency generation_time policy_overhead throughput total_tokens "
    "exact_match precision recall f1 rouge_1 rouge_2 rouge_l semantic_similarity prediction_length "
    "reference_length length_ratio length_difference customer_service_coverage sales_coverage "
    "support_coverage retention_coverage overall_keyword_coverage analytical_coverage "
    "structure_coverage reasoning_depth"
).split()


@query(
    "aggregate_metrics",
    _from_results(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, avg({m}) AS mean, CAST(min({m}) AS DOUBLE) AS min,
            CAST(max({m}) AS DOUBLE) AS max, stddev_pop({m}) AS std, count({m}) AS count FROM results"""
            for m in _METRICS
        ),
        "mean min max std",
    ),
)
def aggregate_metrics(spark, sf_dir):
    return rounded(reports.aggregate_metrics(results(spark, sf_dir, heavy=True)))


@query(
    "nearest_rank_percentiles",
    _from_results(
        """, sorted AS (SELECT policy_name, benchmark, list_sort(list(first_token_latency)
             FILTER (first_token_latency IS NOT NULL)) AS v FROM results GROUP BY ALL),
        wanted(percentile, p) AS (VALUES ('p50', 0.5::DOUBLE), ('p90', 0.9::DOUBLE),
                                         ('p95', 0.95::DOUBLE), ('p99', 0.99::DOUBLE))
        SELECT policy_name, benchmark, percentile,
               v[1 + CAST(floor(p * (len(v) - 1)) AS BIGINT)] AS value FROM sorted, wanted""",
        "value",
    ),
)
def nearest_rank_percentiles(spark, sf_dir):
    rows = results(spark, sf_dir, heavy=True)
    keys = ["policy_name", "benchmark"]
    return rounded(reports.nearest_rank_percentiles(rows, keys, "first_token_latency"))


def _boxes(column: str) -> str:
    return f""", boxes AS (
      SELECT policy_name, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
             quantile_cont({column}, 0.75) AS q3 FROM results GROUP BY policy_name),
    fenced AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM boxes)"""


@query(
    "box_stats",
    _from_results(
        f"""{_boxes('throughput')}
        SELECT f.policy_name, q1, median, q3, min(throughput) FILTER (throughput >= lo) AS whisker_low,
          max(throughput) FILTER (throughput <= hi) AS whisker_high,
          count(*) FILTER (throughput < lo OR throughput > hi) AS outliers
        FROM results r JOIN fenced f USING (policy_name) GROUP BY f.policy_name, q1, median, q3""",
        "q1 median q3 whisker_low whisker_high",
    ),
)
def box_stats(spark, sf_dir):
    return rounded(reports.box_stats(results(spark, sf_dir, heavy=True)))


@query(
    "box_outliers",
    _from_results(
        f"""{_boxes('exact_match')}
        SELECT sample_id, r.policy_name, benchmark, exact_match
        FROM results r JOIN fenced f USING (policy_name) WHERE exact_match < lo OR exact_match > hi""",
        "exact_match",
    ),
)
def box_outliers(spark, sf_dir):
    return rounded(reports.box_outliers(results(spark, sf_dir, heavy=True), "exact_match"))


@query(
    "value_bounds",
    _from_results(
        """SELECT CAST(to_timestamp(min(timestamp)) AT TIME ZONE 'UTC' AS DATE) AS first_date,
        CAST(to_timestamp(max(timestamp)) AT TIME ZONE 'UTC' AS DATE) AS last_date FROM results"""
    ),
)
def value_bounds(spark, sf_dir):
    return reports.value_bounds(results(spark, sf_dir))


@query(
    "uniqueness_report",
    _from_results(
        """SELECT count(DISTINCT prompt) AS unique_prompts, count(DISTINCT response) AS unique_responses,
        count(DISTINCT ground_truth) AS unique_ground_truths FROM results"""
    ),
)
def uniqueness_report(spark, sf_dir):
    return reports.uniqueness_report(results(spark, sf_dir))


@query(
    "slo_scorecard",
    _from_results(
        """, measured AS (SELECT policy_name, avg(throughput) AS avg_throughput, avg(rouge_l) AS avg_rouge_l,
          avg(CASE WHEN error IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS error_rate,
          quantile_cont(first_token_latency, 0.95) AS p95_latency FROM results GROUP BY policy_name)
        SELECT *, p95_latency < 2.0 AS latency_ok, avg_throughput > 300 AS throughput_ok,
          avg_rouge_l > 0.1 AS quality_ok, error_rate < 0.01 AS errors_ok FROM measured""",
        "avg_throughput avg_rouge_l error_rate p95_latency",
    ),
)
def slo_scorecard(spark, sf_dir):
    return rounded(reports.slo_scorecard(results(spark, sf_dir, heavy=True)))


_TREND = "mean_first_token_latency mean_throughput mean_rouge_l mean_f1"


@query(
    "run_trend",
    rounded_sql(
        f"""WITH {twins.STAGED} SELECT run_date, run_hour, count(*) AS samples,
        avg(first_token_latency) AS mean_first_token_latency, avg(throughput) AS mean_throughput,
        avg(rouge_l) AS mean_rouge_l, avg(f1) AS mean_f1 FROM staged GROUP BY run_date, run_hour""",
        _TREND,
    ),
)
def run_trend(spark, sf_dir):
    return rounded(reports.run_trend(staged(spark, sf_dir)))


@query(
    "policy_benchmark_pivot",
    _from_results(
        """SELECT policy_name, avg(f1) FILTER (benchmark = 'crmarena') AS crmarena,
        avg(f1) FILTER (benchmark = 'worfbench') AS worfbench FROM results GROUP BY policy_name""",
        "crmarena worfbench",
    ),
)
def policy_benchmark_pivot(spark, sf_dir):
    return rounded(reports.policy_benchmark_pivot(results(spark, sf_dir), SUITES))


@query(
    "radar_scores",
    rounded_sql(
        f"""WITH {twins.STATS}, firsts AS (
          SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY policy_name ORDER BY benchmark) = 1)
        SELECT policy_name,
          CASE WHEN mean_first_token_latency > 0 THEN 1 / (1 + mean_first_token_latency) ELSE 1.0::DOUBLE END AS latency_score,
          least(mean_throughput, 1.0::DOUBLE) AS throughput_score, least(mean_f1, 1.0::DOUBLE) AS f1_score,
          least(mean_rouge_l, 1.0::DOUBLE) AS rouge_l_score FROM firsts""",
        "latency_score throughput_score f1_score rouge_l_score",
    ),
)
def radar_scores(spark, sf_dir):
    return rounded(reports.radar_scores(_means_only(spark, sf_dir)))


@query(
    "top10_efficiency",
    rounded_sql(
        f"""WITH {twins.SUMMARY} SELECT policy_name, benchmark, efficiency_score FROM summary
        WHERE efficiency_score IS NOT NULL
        ORDER BY efficiency_score DESC, policy_name, benchmark LIMIT 10""",
        "efficiency_score",
    ),
)
def top10_efficiency(spark, sf_dir):
    top = reports.top_efficiency(_ranked(spark, sf_dir))
    return rounded(top.select("policy_name", "benchmark", "efficiency_score"))


@query(
    "head_n",
    _from_results(
        "SELECT sample_id, policy_name, benchmark, f1 FROM results ORDER BY sample_id LIMIT 50", "f1"
    ),
)
def head_n(spark, sf_dir):
    head = reports.head_rows(results(spark, sf_dir))
    return rounded(head.select("sample_id", "policy_name", "benchmark", "f1"))


@query(
    "sample_sequence",
    _from_results(
        """, numbered AS (SELECT sample_id, policy_name, benchmark, row_number() OVER
          (PARTITION BY policy_name, benchmark ORDER BY timestamp, sample_id) AS sample_number FROM results)
        SELECT sample_id, sample_number, policy_name || '_' || benchmark || '_' ||
          CASE WHEN sample_number < 10000 THEN lpad(CAST(sample_number AS VARCHAR), 4, '0')
               ELSE CAST(sample_number AS VARCHAR) END AS sequence_id FROM numbered"""
    ),
)
def sample_sequence(spark, sf_dir):
    numbered = reports.sample_sequence(results(spark, sf_dir, heavy=True), ["timestamp", "sample_id"])
    return numbered.select("sample_id", "sample_number", "sequence_id")


@query(
    "union_runs",
    _from_results(
        """, runs AS (
          SELECT sample_id, policy_name, benchmark, first_token_latency, overall_keyword_coverage,
                 CAST(NULL AS DOUBLE) AS reasoning_depth FROM results WHERE benchmark = 'crmarena'
          UNION ALL
          SELECT sample_id, policy_name, benchmark, first_token_latency, NULL, reasoning_depth
          FROM results WHERE benchmark = 'worfbench')
        SELECT * FROM runs""",
        "first_token_latency overall_keyword_coverage reasoning_depth",
    ),
)
def union_runs_by_name(spark, sf_dir):
    """Two runs, each with the columns of its own suite only."""
    common = ["sample_id", "policy_name", "benchmark", "first_token_latency"]
    rows = results(spark, sf_dir)
    crm = rows.where(F.col("benchmark") == "crmarena").select(*common, "overall_keyword_coverage")
    worf = rows.where(F.col("benchmark") == "worfbench").select(*common, "reasoning_depth")
    return rounded(union_runs([crm, worf]))


@query(
    "union_suites",
    _from_results(
        """SELECT benchmark, count(*) AS samples, avg(first_token_latency) AS mean_first_token_latency
        FROM results GROUP BY benchmark""",
        "mean_first_token_latency",
    ),
)
def union_suites(spark, sf_dir):
    rows = results(spark, sf_dir)
    suites = [filters.filter_results(rows, benchmarks=[suite]) for suite in SUITES]
    both = union_runs(suites).groupBy("benchmark")
    return rounded(
        both.agg(
            F.count("*").alias("samples"),
            F.avg("first_token_latency").alias("mean_first_token_latency"),
        )
    )


@query(
    "scalar_functions",
    """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS three_days_before,
      strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS a_week_later,
      'crm_' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0')
                     ELSE CAST(o_orderkey AS VARCHAR) END AS padded_id,
      split_part(o_orderpriority, '-', 1) AS first_part, left(o_orderpriority, 50) AS prefix,
      greatest(least(o_totalprice / 100000, 1.0::DOUBLE), 0.5::DOUBLE) AS clamped,
      CAST(to_timestamp(epoch(o_orderdate)) AT TIME ZONE 'UTC' AS DATE) AS day
    FROM orders""",
)
def scalar_functions(spark, sf_dir):
    """Dates, padded ids, parts, prefixes and clamps, as job and result builders use them."""
    from scoreloom.sources.tables import table

    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        key,
        F.date_format(F.date_sub(day, 3), "yyyy-MM-dd").alias("three_days_before"),
        F.date_format(F.date_add(day, 7), "yyyy-MM-dd").alias("a_week_later"),
        F.format_string("crm_%04d", key).alias("padded_id"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("first_part"),
        F.substring("o_orderpriority", 1, 50).alias("prefix"),
        F.greatest(F.least(F.col("o_totalprice") / 100000, F.lit(1.0)), F.lit(0.5)).alias("clamped"),
        F.to_date(run_time(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double"))).alias("day"),
    )


@query(
    "format_number",
    _from_results(
        """SELECT policy_name, benchmark, format('{:,}', CAST(sum(total_tokens) AS BIGINT)) AS tokens,
          format('{:,.3f}', round(sum(generation_time), 6)) AS seconds FROM results GROUP BY policy_name, benchmark"""
    ),
)
def format_number(spark, sf_dir):
    """Totals as a dashboard shows them."""
    totals = results(spark, sf_dir).groupBy("policy_name", "benchmark").agg(
        F.sum("total_tokens").alias("tokens"), F.round(F.sum("generation_time"), 6).alias("seconds")
    )
    return totals.select(
        "policy_name",
        "benchmark",
        filters.format_number(F.col("tokens"), 0).alias("tokens"),
        filters.format_number(F.col("seconds"), 3).alias("seconds"),
    )


def _share_of_truth(prediction, reference):
    return F.length(prediction) / F.length(reference)


@query(
    "open_columns",
    _from_results(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, avg({m}) AS mean, CAST(min({m}) AS DOUBLE) AS min,
            CAST(max({m}) AS DOUBLE) AS max, stddev_pop({m}) AS std, count({m}) AS count FROM with_own"""
            for m in [*_METRICS, "share_of_truth"]
        ).join([", with_own AS (SELECT *, CASE WHEN benchmark = 'worfbench' THEN length(response) / CAST(length(ground_truth) AS DOUBLE) END AS share_of_truth FROM results) ", ""]),
        "mean min max std",
    ),
)
def open_columns(spark, sf_dir):
    """A metric of the user's own, registered by name, stored by one run of two, found and aggregated undeclared."""
    registry.register_metric("share_of_truth", _share_of_truth)
    own = registry.registered_metrics()["share_of_truth"]
    registry.unregister_metric("share_of_truth")
    path = scratch(spark, "open-results")
    rows = results(spark, sf_dir)
    append_results(rows.where(F.col("benchmark") == "crmarena"), path)
    worf = rows.where(F.col("benchmark") == "worfbench")
    append_results(worf.withColumn("share_of_truth", own(F.col("response"), F.col("ground_truth"))), path)
    return rounded(reports.aggregate_metrics(scan_open_results(spark, path)))

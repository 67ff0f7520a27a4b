"""Queries that run the streaming flows to completion over what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.catalog import twins
from scoreloom.catalog.registry import query, rounded, rounded_sql
from scoreloom.catalog.runs import _TIMINGS, TIMED_SQL, TIMING_PLACES
from scoreloom.session import scratch
from scoreloom.sources.results import scan_results
from scoreloom.sources.tables import chunks_from, results_from, table
from scoreloom.streaming import flows, requests


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    # A glob with one match: a file stream takes folders and patterns, not the path of a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(
    "stream_generation_metrics",
    rounded_sql(
        f"""WITH {TIMED_SQL}
        SELECT * EXCLUDE (e) FROM timed
        WHERE e + 86400000000 <= (SELECT max(epoch_us(chunk_ts)) FROM chunks) - 3600000000""",
        _TIMINGS,
        TIMING_PLACES,
    ),
)
def stream_generation_metrics(spark, sf_dir):
    """Requests silent for a day an hour before the newest chunk; facts of the rest are kept with theirs."""
    stream = chunks_from(arriving(spark, sf_dir, "events"))
    path = scratch(spark, "timings")
    flows.append_facts(stream, flows.timing_facts, path, scratch(spark, "timings-log")).awaitTermination()
    return rounded(flows.merged_timings(spark.read.parquet(path)), TIMING_PLACES)


@query(
    "stream_append_results",
    rounded_sql(
        f"WITH {twins.RESULTS} SELECT sample_id, policy_name, benchmark, throughput, error FROM results",
        "throughput",
    ),
)
def stream_append_results(spark, sf_dir):
    """Results delivered twice in one stream, stored once."""
    rows = results_from(arriving(spark, sf_dir, "lineitem"))
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    path = scratch(spark, "appended")
    stream = flows.stream_distinct_results(twice)
    flows.append_batches(stream, path, scratch(spark, "appended-log")).awaitTermination()
    columns = ["sample_id", "policy_name", "benchmark", "throughput", "error"]
    return rounded(scan_results(spark, path).select(*columns))


@query(
    "stream_run_trend",
    rounded_sql(
        f"""WITH {twins.RESULTS}
        SELECT to_timestamp(floor(timestamp / 3600) * 3600) AT TIME ZONE 'UTC' AS hour_start,
          count(*) AS samples, avg(first_token_latency) AS mean_first_token_latency,
          avg(throughput) AS mean_throughput, avg(rouge_l) AS mean_rouge_l, avg(f1) AS mean_f1
        FROM results GROUP BY 1""",
        "mean_first_token_latency mean_throughput mean_rouge_l mean_f1",
    ),
)
def stream_run_trend(spark, sf_dir):
    stream = results_from(arriving(spark, sf_dir, "lineitem"))
    path = scratch(spark, "trend")
    flows.append_facts(stream, flows.trend_facts, path, scratch(spark, "trend-log")).awaitTermination()
    return rounded(flows.merged_trend(spark.read.parquet(path)))


@query(
    "stream_unseen_results",
    rounded_sql(
        f"WITH {twins.RESULTS} SELECT sample_id, policy_name, benchmark, throughput, error FROM results",
        "throughput",
    ),
)
def stream_unseen_results(spark, sf_dir):
    """Everything delivered once more by a stream that remembers nothing; stored once, by what the table holds."""
    path = scratch(spark, "unseen")
    for delivery in ("first", "second"):
        rows = results_from(arriving(spark, sf_dir, "lineitem"))
        flows.append_unseen(rows, path, scratch(spark, f"unseen-log-{delivery}")).awaitTermination()
    columns = ["sample_id", "policy_name", "benchmark", "throughput", "error"]
    return rounded(scan_results(spark, path).select(*columns))


_DAY, _DELAY = 86_400_000, 3_600_000
_FACTS_SQL = """min(s) AS s, min(f) AS f, max(e) AS e, CAST(sum(n) AS BIGINT) AS n"""


@query(
    "stream_requests",
    f"""WITH marked AS (
      SELECT event_id % 2 AS slice, concat_ws('/', user_id, strftime(ts, '%Y-%m-%d')) AS request_id,
        epoch_us(date_trunc('day', ts)) AS s, epoch_us(ts) AS e,
        CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS f,
        CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS n FROM events),
    parts AS (SELECT slice, request_id, {_FACTS_SQL} FROM marked GROUP BY ALL),
    clocks AS (SELECT max(e) FILTER (slice = 0) // 1000 - {_DELAY} AS early, max(e) // 1000 - {_DELAY} AS final FROM marked),
    -- The first slice against the clock it sets: a request without late chunk stays open.
    earlier AS (SELECT parts.*, (e + 999) // 1000 + {_DAY} <= early AS done FROM parts, clocks WHERE slice = 0),
    later AS (
      SELECT p.*, coalesce(NOT a.done, FALSE) AS joins, coalesce(a.done AND p.e <= a.e + {1000 * _DAY}, FALSE)
        OR (p.e + 999) // 1000 + {_DAY} <= early AS gone
      FROM parts p JOIN clocks ON TRUE LEFT JOIN earlier a USING (request_id) WHERE p.slice = 1),
    alive AS (
      SELECT request_id, {_FACTS_SQL} FROM (
        SELECT request_id, s, f, e, n FROM earlier WHERE NOT done
        UNION ALL SELECT request_id, s, f, e, n FROM later WHERE joins OR NOT gone) GROUP BY 1),
    outcomes AS (
      SELECT request_id, 'closed' AS outcome, s, f, e, n FROM earlier WHERE done
      UNION ALL SELECT request_id, 'late', s, f, e, n FROM later WHERE gone AND NOT joins
      UNION ALL SELECT request_id, CASE WHEN (e + 999) // 1000 + {_DAY} <= final THEN 'closed' ELSE 'open' END, s, f, e, n
      FROM alive, clocks)
    SELECT request_id, outcome, s AS started_at, f AS first_ts, e AS end_ts, n AS total_tokens FROM outcomes""",
)
def stream_requests(spark, sf_dir):
    """All chunks in two arrivals, the second full of stragglers: requests closed and still open, and late parts."""
    events = table(spark, sf_dir, "events")
    folder, out, log = (scratch(spark, f"requests-{name}") for name in ("in", "out", "log"))
    for arrival in range(2):
        arrived = events.where(F.pmod("event_id", F.lit(2)) == arrival)
        arrived.write.parquet(f"{folder}/arrival={arrival}")
        chunks = chunks_from(spark.readStream.schema(events.schema).parquet(f"{folder}/arrival=*"))
        requests.append_requests(requests.stream_requests(chunks), out, log).awaitTermination()
    return requests.written_requests(spark, out).unionByName(requests.open_requests(spark, log))

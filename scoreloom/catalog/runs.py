"""Queries of sources, sinks, jobs, requests and generation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scoreloom.catalog import twins
from scoreloom.catalog.registry import query, rounded, rounded_sql
from scoreloom.plans import benchmark, generation, policies, reports
from scoreloom.schemas import RESULTS
from scoreloom.session import scratch
from scoreloom.sources import jobs as job_source
from scoreloom.sources import results as store
from scoreloom.sources.tables import chat_jobs, chunks_from, results, suite_jobs, table

_CHAT_COLUMNS = "id, prompt, ground_truth, source, category"


@query("normalize_conversations", f"WITH {twins.CHATS} SELECT {_CHAT_COLUMNS} FROM chats")
def normalize_conversations(spark, sf_dir):
    return chat_jobs(spark, sf_dir).drop("conv_id")


@query(
    "normalize_nested_conversations",
    """SELECT conv_id || '/' || turn AS id, CASE WHEN role = 'user' THEN text ELSE 'Go on.' END AS prompt,
      CASE WHEN role = 'assistant' THEN text ELSE '' END AS ground_truth,
      'worfbench' AS source, 'eval' AS category FROM conversations""",
)
def normalize_nested_conversations(spark, sf_dir):
    """Nested chats, an opening and one turn each, written as JSON lines and read back."""
    nested = table(spark, sf_dir, "conversations").selectExpr(
        "concat(conv_id, '/', turn) AS id",
        "array(named_struct('role', 'user', 'content', 'Go on.'), "
        "named_struct('role', role, 'content', text)) AS conversations",
    )
    path = scratch(spark, "chats")
    job_source.write_jobs(nested, path)
    return job_source.scan_chat_jobs(spark, path)


_JOBS_SQL = f"WITH {twins.SUITE_JOBS} SELECT sample_id, prompt, ground_truth FROM jobs"


def _jobs_file(spark, sf_dir):
    path = scratch(spark, "jobs")
    job_source.write_jobs(suite_jobs(spark, sf_dir), path)
    return job_source.scan_jobs(spark, path)


@query("scan_jobs_jsonl", f"{_JOBS_SQL} WHERE prompt IS NOT NULL")
def scan_jobs_jsonl(spark, sf_dir):
    return job_source.good_jobs(_jobs_file(spark, sf_dir)).drop("metadata")


@query(
    "sink_jobs_jsonl",
    f"WITH {twins.SUITE_JOBS} SELECT count(*) AS jobs, count(*) - count(prompt) AS rejected FROM jobs",
)
def sink_jobs_jsonl(spark, sf_dir):
    return _jobs_file(spark, sf_dir).agg(
        F.count("*").alias("jobs"), F.count("reject").alias("rejected")
    )


_STORED = ", ".join(RESULTS.fieldNames())
_STORED_DOUBLES = " ".join(f.name for f in RESULTS if f.dataType.typeName() == "double")


def _stored_sql(times: int = 1) -> str:
    body = " UNION ALL ".join([f"SELECT {_STORED} FROM results"] * times)
    return rounded_sql(f"WITH {twins.RESULTS} {body}", _STORED_DOUBLES)


@query(
    "quarantine_jobs",
    f"""WITH {twins.SUITE_JOBS}, told AS (
      SELECT CASE WHEN length(prompt) % 5 = 0 THEN 'prompt is missing' WHEN length(ground_truth) % 7 = 0 THEN 'ground_truth is missing' END AS reason
      FROM jobs)
    SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'rejected' END AS route, reason, count(*) AS jobs FROM told GROUP BY ALL""",
)
def quarantine_jobs(spark, sf_dir):
    """Job lines, some without a prompt or truth; one write sends good and rejected ones to folders of their own."""
    lines = suite_jobs(spark, sf_dir).withColumns(
        {
            "ground_truth": F.when(F.length("ground_truth") % 7 != 0, F.col("ground_truth")),
            "prompt": F.when(F.length("prompt") % 5 != 0, F.col("prompt")),
        }
    )
    path, routed = scratch(spark, "jobs"), scratch(spark, "routed-jobs")
    job_source.write_jobs(lines, path)
    scanned = job_source.scan_jobs(spark, path)
    store.write_routed(scanned, F.col("reject"), routed)
    stored = store.scan_routed(spark, routed, scanned.schema)
    return stored.groupBy("route", F.col("reject").alias("reason")).agg(F.count("*").alias("jobs"))


@query("sink_results_parquet", _stored_sql())
def sink_results_parquet(spark, sf_dir):
    path = scratch(spark, "results")
    store.write_results(results(spark, sf_dir), path)
    return rounded(store.scan_results(spark, path).select(*_STORED.split(", ")))


@query(
    "scan_results_parquet",
    rounded_sql(
        f"""WITH {twins.RESULTS} SELECT policy_name, count(*) AS samples, avg(f1) AS mean_f1
        FROM results WHERE benchmark = 'crmarena' GROUP BY policy_name""",
        "mean_f1",
    ),
)
def scan_results_parquet(spark, sf_dir):
    """One suite of a stored table: only its folders are read."""
    path = scratch(spark, "results")
    store.write_results(results(spark, sf_dir), path)
    suite = store.scan_results(spark, path).where(F.col("benchmark") == "crmarena")
    grouped = suite.groupBy("policy_name")
    return rounded(grouped.agg(F.count("*").alias("samples"), F.avg("f1").alias("mean_f1")))


@query("append_results", _stored_sql(2))
def append_results(spark, sf_dir):
    path = scratch(spark, "results")
    run = results(spark, sf_dir)
    store.append_results(run, path)
    store.append_results(run, path)
    return rounded(store.scan_results(spark, path).select(*_STORED.split(", ")))


@query("export_csv", _stored_sql())
def export_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    store.export_csv(results(spark, sf_dir), path, "gzip")
    return rounded(store.scan_csv(spark, path, RESULTS).select(*_STORED.split(", ")))


@query(
    "scan_summary",
    rounded_sql(
        f"""WITH {twins.RESULTS} SELECT policy_name, benchmark, avg(first_token_latency) AS mean_first_token_latency,
        avg(throughput) AS mean_throughput, avg(rouge_l) AS mean_rouge_l
        FROM results GROUP BY policy_name, benchmark""",
        "mean_first_token_latency mean_throughput mean_rouge_l",
    ),
)
def scan_summary(spark, sf_dir):
    built = reports.performance_summary(results(spark, sf_dir))
    store.materialize_table(built, "short_summary", scratch(spark, "short_summary"))
    return rounded(store.scan_summary(spark, "short_summary", built.schema))


_TEMPLATES = [
    job_source.Template(
        "An order of {date} was promised for {expected_date} and has not come. What do you reply?",
        "say sorry, give the tracking state, offer a discount",
        "customer_service",
    ),
    job_source.Template(
        "A buyer finds the larger plan too dear. How do you answer?",
        "name the value, compare the cost, offer monthly payment",
        "sales",
    ),
    job_source.Template(
        "Sign-in fails since {date}. What comes next?",
        "check the account, pass it to technical support",
        "technical_support",
    ),
]


def _case(values: list[str], index: str) -> str:
    return f"([{', '.join(twins.quoted(v) for v in values)}])[{index} + 1]"


_PICK = f"(o_orderkey * 7 + 3) % {len(_TEMPLATES)}"


@query(
    "expand_templates",
    f"""SELECT 'crm_' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0')
                             ELSE CAST(o_orderkey AS VARCHAR) END AS sample_id,
      replace(replace({_case([t.prompt for t in _TEMPLATES], _PICK)},
        '{{date}}', strftime(o_orderdate, '%Y-%m-%d')),
        '{{expected_date}}', strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 + 2 AS INTEGER), '%Y-%m-%d')) AS prompt,
      {_case([t.ground_truth for t in _TEMPLATES], _PICK)} AS ground_truth,
      {_case([t.category for t in _TEMPLATES], _PICK)} AS category,
      {_case(job_source.DIFFICULTY, "o_orderkey % 3")} AS difficulty,
      {_case(job_source.LEVEL, "(o_orderkey // 3) % 3")} AS priority
    FROM orders""",
)
def expand_templates(spark, sf_dir):
    """One job per order."""
    orders = table(spark, sf_dir, "orders")
    made = job_source.expand_templates(orders, "o_orderkey", "o_orderdate", _TEMPLATES, "crmarena")
    metadata = [F.col("metadata")[k].alias(k) for k in ("category", "difficulty", "priority")]
    return made.select("sample_id", "prompt", "ground_truth", *metadata)


_WORKFLOW = [
    job_source.Template("Plan the move of a service to another region by {expected_date}.", "inventory, copy, switch, verify", "operations_move"),
    job_source.Template("Compare two storage designs as of {date}.", "list needs, weigh cost, choose", "analysis"),
]
_TURN = f"(o_orderkey * 7 + 3) % {len(_WORKFLOW)}"


@query(
    "expand_workflow_templates",
    f"""SELECT 'worf_' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0')
                              ELSE CAST(o_orderkey AS VARCHAR) END AS sample_id,
      replace(replace({_case([t.prompt for t in _WORKFLOW], _TURN)},
        '{{date}}', strftime(o_orderdate, '%Y-%m-%d')),
        '{{expected_date}}', strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 + 2 AS INTEGER), '%Y-%m-%d')) AS prompt,
      {_case([t.ground_truth for t in _WORKFLOW], _TURN)} AS ground_truth,
      {_case([t.category for t in _WORKFLOW], _TURN)} AS category,
      {_case(job_source.LEVEL, "o_orderkey % 3")} AS complexity,
      split_part({_case([t.category for t in _WORKFLOW], _TURN)}, '_', 1) AS domain
    FROM orders""",
)
def expand_workflow_templates(spark, sf_dir):
    """One workflow job per order; the first part of a category is its domain."""
    orders = table(spark, sf_dir, "orders")
    made = job_source.expand_templates(orders, "o_orderkey", "o_orderdate", _WORKFLOW, "worfbench")
    metadata = [F.col("metadata")[k].alias(k) for k in ("category", "complexity", "domain")]
    return made.select("sample_id", "prompt", "ground_truth", *metadata)


_NAMES = ", ".join(f"('{p.name}')" for p in policies.POLICIES)


@query(
    "cross_policy_jobs",
    f"""WITH {twins.SUITE_JOBS}, names(policy_name) AS (VALUES {_NAMES})
    SELECT sample_id, benchmark, policy_name FROM jobs CROSS JOIN names""",
)
def cross_policy_jobs(spark, sf_dir):
    jobs = suite_jobs(spark, sf_dir).select("sample_id", "benchmark")
    return policies.cross_policies(jobs)


@query(
    "policy_table",
    f"""WITH {twins.RESULTS}, {twins.POLICY_VALUES},
    sizes AS (SELECT policy_name, count(*) AS n_params FROM policies GROUP BY policy_name),
    used AS (SELECT policy_name, count(*) AS samples FROM results GROUP BY policy_name)
    SELECT policy_name, samples, n_params FROM used JOIN sizes USING (policy_name)""",
)
def policy_table(spark, sf_dir):
    """Registered policies with the number of results each has."""
    used = results(spark, sf_dir).groupBy("policy_name").agg(F.count("*").alias("samples"))
    registry = policies.policy_table(spark).select(
        "policy_name", F.size("defaults").cast("long").alias("n_params")
    )
    return used.join(F.broadcast(registry), "policy_name")


@query(
    "resolve_policy_config",
    f"""WITH {twins.RESULTS}, {twins.POLICY_VALUES}
    SELECT r.sample_id, 1024 AS max_tokens, 0.7::DOUBLE AS temperature, 1.0::DOUBLE AS top_p,
      (SELECT max(v) FROM policies p WHERE p.policy_name = r.policy_name AND k = 'variant') AS variant
    FROM results r""",
)
def resolve_policy_config(spark, sf_dir):
    used = results(spark, sf_dir).select("sample_id", "policy_name")
    resolved = policies.resolve_policy_config(used)
    variant = F.col("params")["variant"].alias("variant")
    return resolved.select("sample_id", "max_tokens", "temperature", "top_p", variant)


@query(
    "known_policies",
    f"""WITH {twins.RESULTS} SELECT policy_name IN ('early_exit_28', 'early_exit_32') AS known,
    count(*) AS samples FROM results GROUP BY 1""",
)
def known_policies(spark, sf_dir):
    """Rows of a registry of two policies, and the rows it rejects."""
    two = [p for p in policies.POLICIES if p.name.startswith("early_exit")]
    rows = results(spark, sf_dir).select("policy_name")
    return policies.flag_known(rows, two).groupBy("known").agg(F.count("*").alias("samples"))


_REQUESTS = f"""{twins.SUITE_JOBS}, names(policy_name) AS (VALUES {_NAMES}),
requests AS (
  SELECT sample_id, policy_name,
    CASE policy_name WHEN 'early_exit_28' THEN CAST(floor(1024 * (28 / 32.0::DOUBLE)) AS INTEGER)
      WHEN 'early_exit_32' THEN 1024
      WHEN 'adaptive_kv_static' THEN CAST(floor(1024 * 0.8::DOUBLE) AS INTEGER)
      WHEN 'adaptive_kv_cosine' THEN CAST(floor(1024 * (0.5::DOUBLE * (1 + cos(pi() * 0.8::DOUBLE)))) AS INTEGER)
      ELSE 1024 END AS max_tokens,
    CASE policy_name WHEN 'dynamic_pruning_entropy' THEN greatest(0.1::DOUBLE, 0.7::DOUBLE * (2.0::DOUBLE / 3.0::DOUBLE))
      ELSE 0.7::DOUBLE END AS temperature,
    CASE policy_name WHEN 'dynamic_pruning_top_p' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS top_p,
    CASE policy_name WHEN 'speculative_decoding' THEN 2 WHEN 'speculative_decoding_4token' THEN 5
      WHEN 'elastic_batch_greedy' THEN 4 WHEN 'elastic_batch_sorted' THEN 4 ELSE 1 END AS fan_out
  FROM jobs CROSS JOIN names)"""


@query(
    "plan_requests",
    rounded_sql(f"WITH {_REQUESTS} SELECT * FROM requests", "temperature top_p"),
)
def plan_requests(spark, sf_dir):
    columns = ["sample_id", "policy_name", "max_tokens", "temperature", "top_p", "fan_out"]
    return rounded(policies.plan_requests(suite_jobs(spark, sf_dir)).select(*columns))


@query(
    "plan_candidates",
    rounded_sql(
        f"""WITH {_REQUESTS}, spread AS (SELECT *, unnest(range(fan_out)) AS i FROM requests)
        SELECT sample_id, policy_name, CAST(i AS INTEGER) AS candidate,
          CASE WHEN starts_with(policy_name, 'elastic') THEN least(temperature + 0.05::DOUBLE * i, 1.0::DOUBLE)
               ELSE temperature END AS temperature FROM spread""",
        "temperature",
    ),
)
def plan_candidates(spark, sf_dir):
    planned = policies.plan_candidates(policies.plan_requests(suite_jobs(spark, sf_dir)))
    return rounded(planned.select("sample_id", "policy_name", "candidate", "temperature"))


@query(
    "limit_per_source",
    """SELECT doc_id, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25""",
)
def limit_per_source(spark, sf_dir):
    """The feature itself: at most n jobs of each source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return reports.limit_per_source(documents, "source", "doc_id", 25)


def _buckets_sql(order: str) -> str:
    return f"""SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {order}) - 1) // 4
    AS batch_id FROM documents"""


@query("length_buckets", _buckets_sql("n_chars, doc_id"))
def length_buckets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    batched = generation.length_buckets(documents, 4, "lang", "doc_id", "n_chars")
    return batched.select("doc_id", "lang", "batch_id")


@query("arrival_buckets", _buckets_sql("doc_id"))
def arrival_buckets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return generation.length_buckets(documents, 4, "lang", "doc_id")


# Microsecond stamps over small counts would sit on rounding ties at six places.
TIMING_PLACES = 9
_TIMINGS = "first_token_latency avg_token_latency throughput generation_time"
TIMED_SQL = f"""{twins.CHUNKS},
grouped AS (
  SELECT request_id, min(epoch_us(started_at)) AS s, max(epoch_us(chunk_ts)) AS e,
    min(epoch_us(chunk_ts)) FILTER (content <> '') AS f, count(*) FILTER (content <> '') AS total_tokens
  FROM chunks GROUP BY request_id),
timed AS (
  SELECT request_id, coalesce((f - s) / 1e6, 0.0::DOUBLE) AS first_token_latency,
    coalesce((e - f) / 1e6 / greatest(total_tokens, 1), 0.0::DOUBLE) AS avg_token_latency,
    total_tokens, total_tokens / nullif((e - s) / 1e6, 0) AS throughput,
    (e - s) / 1e6 AS generation_time, e FROM grouped)"""


@query(
    "generation_metrics",
    rounded_sql(f"WITH {TIMED_SQL} SELECT * EXCLUDE (e) FROM timed", _TIMINGS, TIMING_PLACES),
)
def generation_metrics(spark, sf_dir):
    chunks = chunks_from(table(spark, sf_dir, "events"))
    return rounded(generation.generation_metrics(chunks), TIMING_PLACES)


@query(
    "pick_candidate",
    """SELECT conv_id, coalesce(first(CASE WHEN role = 'system' THEN '' ELSE text END ORDER BY turn), '') AS response
    FROM conversations GROUP BY conv_id""",
)
def pick_candidate(spark, sf_dir):
    """Turns as candidates; system turns stand for failed ones."""
    text = F.when(F.col("role") != "system", F.col("text"))
    turns = table(spark, sf_dir, "conversations").withColumn("text", text)
    return generation.pick_candidate(turns, "conv_id", "turn", "text")


def shout(prompt: str, request: dict) -> str:
    """A stand-in generator that refuses long prompts."""
    if len(prompt) > 200:
        raise ValueError("prompt too long")
    return f"{request['policy_name']}: {prompt[::-1]}"


@query(
    "apply_generator",
    f"""WITH {twins.SUITE_JOBS}, names(policy_name) AS (VALUES {_NAMES})
    SELECT sample_id, policy_name,
      CASE WHEN length(prompt) <= 200 THEN policy_name || ': ' || array_to_string(list_reverse(string_split(prompt, '')), '') END AS response,
      CASE WHEN length(prompt) > 200 THEN 'ValueError: prompt too long' END AS error
    FROM jobs CROSS JOIN names""",
)
def apply_generator(spark, sf_dir):
    requests = policies.plan_requests(suite_jobs(spark, sf_dir)).drop("params")
    answered = generation.apply_generator(requests, shout)
    return answered.select("sample_id", "policy_name", "response", "error")


def in_pieces(prompt: str, request: dict):
    """A stand-in generator that says the prompt again, word by word, and refuses long ones."""
    if len(prompt) > 200:
        raise ValueError("prompt too long")
    yield from re.split(r"(?<= )", prompt)


_RUN_MEANS = "mean_exact_match mean_precision mean_recall mean_f1 mean_reference_length mean_policy_overhead"


@query(
    "benchmark_run",
    rounded_sql(
        f"""WITH {twins.SUITE_JOBS}, names(policy_name) AS (VALUES {_NAMES}),
        scored AS (
          SELECT benchmark, length(prompt) > 200 AS failed, {twins.tokens_sql("prompt")} AS p, {twins.tokens_sql("ground_truth")} AS r,
            CAST({twins.normalize_sql("prompt")} = {twins.normalize_sql("ground_truth")} AS DOUBLE) AS same,
            len({twins.word_tokens_sql("ground_truth")}) AS words FROM jobs),
        sizes AS (
          SELECT *, len(list_intersect(list_distinct(p), list_distinct(r))) AS s, len(list_distinct(p)) AS np, len(list_distinct(r)) AS nr FROM scored),
        rates AS (SELECT *, {twins.ratio_sql("s", "np")} AS precision, {twins.ratio_sql("s", "nr")} AS recall FROM sizes)
        SELECT policy_name, benchmark, count(*) AS requests, count(*) AS stored, count(*) FILTER (failed) AS failed, 0::BIGINT AS untimed,
          avg(same) FILTER (NOT failed) AS mean_exact_match, avg(precision) FILTER (NOT failed) AS mean_precision, avg(recall) FILTER (NOT failed) AS mean_recall,
          avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END) FILTER (NOT failed) AS mean_f1,
          avg(words) FILTER (NOT failed) AS mean_reference_length,
          avg({twins.overhead_sql()}) FILTER (NOT failed) AS mean_policy_overhead
        FROM rates CROSS JOIN names GROUP BY policy_name, benchmark""",
        _RUN_MEANS,
    ),
)
def benchmark_run(spark, sf_dir):
    """Jobs to scored results in slices; the run stops half way and is started again over all jobs."""
    path, jobs = scratch(spark, "benchmark-run"), suite_jobs(spark, sf_dir)
    benchmark.run_benchmark(jobs, in_pieces, path, slices=2, upto=1)
    table = benchmark.run_benchmark(jobs, in_pieces, path, slices=2)
    answered = F.col("error").isNull()
    timings = ("first_token_latency", "avg_token_latency", "generation_time", "throughput", "total_tokens", "policy_overhead")
    untimed = F.lit(False)
    for name in timings:
        untimed = untimed | F.col(name).isNull()
    means = (F.avg(F.when(answered, F.col(m.removeprefix("mean_")))).alias(m) for m in _RUN_MEANS.split())
    return rounded(
        table.groupBy("policy_name", "benchmark").agg(
            F.count_distinct("sample_id").alias("requests"),
            F.count("*").alias("stored"),
            F.count_if(~answered).alias("failed"),
            F.count_if(answered & untimed).alias("untimed"),
            *means,
        )
    )

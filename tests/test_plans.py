import json

import pytest
from pyspark.sql import functions as F

from scoreloom.plans import benchmark, generation, incremental, mart, policies, reports
from scoreloom.plans.policies import POLICIES
from scoreloom.operators.staging import stage_results
from scoreloom.sources import jobs as job_source
from scoreloom.sources import results as store
from scoreloom.schemas import JOB, RESULTS
from scoreloom.session import small_side
from scoreloom.sources.tables import chunks_from, results, suite_jobs, table
from scoreloom.streaming import flows


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


# --- mart -------------------------------------------------------------------------------


def test_narrowing_brackets_does_not_change_the_mart(spark, sf_dir):
    staged = stage_results(results(spark, sf_dir))
    shape = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))
    small = shape(mart.policy_stats(staged))
    large = shape(mart.policy_stats(staged, kept=5))
    assert small.columns == mart.STATS_ORDER
    assert same_rows(small, large)


def test_approximate_statistics_stay_near(spark, sf_dir):
    staged = stage_results(results(spark, sf_dir))
    exact = {(r[0], r[2]): r["p95_throughput"] for r in mart.policy_stats(staged).collect()}
    for row in mart.policy_stats(staged, exact=False).collect():
        assert row["p95_throughput"] == pytest.approx(exact[row[0], row[2]], rel=0.1)


def test_mart_has_no_join_and_statistics_one_shuffle(spark, sf_dir):
    staged = stage_results(results(spark, sf_dir))
    stats = staged.groupBy(*mart.GROUP).agg(*mart.plain_statistics())
    assert physical(stats).count("Exchange") == 1
    assert "Join" not in physical(mart.build_summary(stats))


def test_joined_and_fused_mart_agree(spark, sf_dir):
    staged = stage_results(results(spark, sf_dir))
    stats = staged.groupBy(*mart.GROUP).agg(*mart.plain_statistics())
    joined = mart.join_stats_efficiency(stats, mart.efficiency_metrics(stats))
    assert same_rows(joined, mart.with_efficiency(stats).select(*joined.columns))


def test_ranks_break_ties_by_name_and_zero_latency_gives_null(spark):
    stats = spark.createDataFrame(
        [("b", "x", "s", 0.0, 1.0, 0.5, 0.0), ("a", "x", "s", 0.0, 1.0, 0.5, 0.0), ("c", "x", "s", None, None, None, None)],
        "policy_name string, policy_category string, benchmark string, mean_first_token_latency double, "
        "mean_throughput double, mean_f1 double, mean_policy_overhead double",
    )
    rows = {r["policy_name"]: r for r in mart.build_summary(stats, stamp=False).collect()}
    assert [rows[p]["latency_rank"] for p in "abc"] == [1, 2, 3]
    assert [rows[p]["latency_percentile"] for p in "abc"] == [0, 0, 1]
    assert rows["a"]["efficiency_score"] is None and rows["a"]["is_pareto_efficient"] is True
    assert rows["c"]["is_pareto_efficient"] is False
    assert rows["a"]["performance_profile"] == "Optimal"


def test_one_row_group_has_no_deviation(spark):
    row = store.conform(spark.createDataFrame([("p", "s", 1.0)], "policy_name string, benchmark string, throughput double"))
    assert mart.policy_stats(stage_results(row)).first()["std_throughput"] is None


# --- reports ----------------------------------------------------------------------------


def test_floor_index_percentiles(spark):
    df = spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    found = {r["percentile"]: r["value"] for r in reports.nearest_rank_percentiles(df, ["g"], "v").collect()}
    assert found == {"p50": 5, "p90": 9, "p95": 9, "p99": 9}


def test_aggregate_metrics_skips_missing(spark):
    df = spark.createDataFrame([("a", 1.0, True, None), ("b", 3.0, False, None)], "sample_id string, x double, y boolean, z double")
    found = {r["metric"]: tuple(r)[1:] for r in reports.aggregate_metrics(df).collect()}
    assert found == {"x": (2.0, 1.0, 3.0, 1.0, 2), "y": (0.5, 0.0, 1.0, 0.5, 2)}


def test_run_summary_only_has_present_columns(spark):
    df = spark.createDataFrame([(0.1, 100.0), (0.3, 80.0)], "first_token_latency double, throughput double")
    assert reports.run_summary(df).columns == ["total_samples", "mean_first_token_latency", "mean_throughput"]
    assert reports.run_summary(df).first()["mean_throughput"] == 90.0


# --- policies and generation ------------------------------------------------------------


def test_effective_parameters(spark):
    jobs = spark.createDataFrame([("j", "hello", "")], "sample_id string, prompt string, ground_truth string")
    rows = {r["policy_name"]: r for r in policies.plan_requests(jobs).collect()}
    tokens = {p: rows[p]["max_tokens"] for p in ("early_exit_28", "early_exit_32", "adaptive_kv_static", "adaptive_kv_cosine")}
    assert tokens == {"early_exit_28": 896, "early_exit_32": 1024, "adaptive_kv_static": 819, "adaptive_kv_cosine": 97}
    assert rows["dynamic_pruning_entropy"]["temperature"] == pytest.approx(0.7 * 2 / 3)
    assert rows["dynamic_pruning_top_p"]["top_p"] == 0.9
    assert rows["speculative_decoding_4token"]["fan_out"] == 5
    assert "Join" in physical(policies.plan_requests(jobs)) and "CartesianProduct" not in physical(policies.plan_requests(jobs))


def test_configured_params_win_over_defaults(spark):
    custom = [policies.Policy("p", defaults={"a": "1", "b": "2"}, params={"b": "9"}, max_tokens=5)]
    df = spark.createDataFrame([("p",), ("unknown",)], "policy_name string")
    rows = {r["policy_name"]: r for r in policies.resolve_policy_config(df, custom).collect()}
    assert rows["p"]["params"] == {"a": "1", "b": "9"} and rows["p"]["max_tokens"] == 5
    assert rows["unknown"]["params"] == {} and rows["unknown"]["max_tokens"] == 1024


def test_generation_metrics_cases(spark):
    chunks = spark.createDataFrame(
        [("r", 0, 1, ""), ("r", 0, 2, "two words"), ("r", 0, 4, "end"), ("blank", 0, 3, None), ("split", 0, 1, "wo"), ("split", 0, 2, "rd")],
        "request_id string, s long, c long, content string",
    ).select("request_id", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("c").alias("chunk_ts"), "content")
    rows = {r["request_id"]: r for r in generation.generation_metrics(chunks).collect()}
    assert (rows["r"]["first_token_latency"], rows["r"]["total_tokens"], rows["r"]["throughput"]) == (2.0, 3, 0.75)
    assert rows["r"]["avg_token_latency"] == pytest.approx(2 / 3)
    assert (rows["blank"]["first_token_latency"], rows["blank"]["total_tokens"]) == (0.0, 0)
    assert rows["split"]["total_tokens"] == 2


def test_generator_failures_become_rows(spark):
    calls = spark.createDataFrame([("a", "ok"), ("b", "bad")], "sample_id string, prompt string")

    def generate(prompt, request):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return prompt.upper()

    generation.register_generator("upper", generate)
    rows = {r["sample_id"]: r for r in generation.apply_generator(calls, "upper").collect()}
    assert rows["a"]["response"] == "OK" and rows["a"]["error"] is None
    assert rows["b"]["response"] is None and rows["b"]["error"] == "RuntimeError: no answer"


# --- sources ----------------------------------------------------------------------------


def test_job_lines_good_bad_and_blank(spark, tmp_path):
    lines = [
        json.dumps({"sample_id": "1", "prompt": "p", "ground_truth": "g", "metadata": {"k": "v"}}),
        "",
        json.dumps({"sample_id": "2", "prompt": "p"}),
        "{broken",
        json.dumps({"sample_id": "3", "prompt": "p", "ground_truth": ""}),
    ]
    (tmp_path / "jobs.jsonl").write_text("\n".join(lines))
    scanned = job_source.scan_jobs(spark, str(tmp_path / "jobs.jsonl"))
    good = {r["sample_id"]: r for r in job_source.good_jobs(scanned).collect()}
    assert set(good) == {"1", "3"} and good["1"]["metadata"] == {"k": "v"} and good["3"]["metadata"] == {}
    assert sorted(r["reject"] for r in job_source.rejected_jobs(scanned).collect()) == [
        "ground_truth is missing",
        "not a JSON object",
    ]


def test_chat_lines(spark, tmp_path):
    turn = lambda role, content: {"role": role, "content": content}
    lines = [
        {"id": "x", "conversations": [turn("user", "u1"), turn("assistant", "a1"), turn("user", "u2")], "category": "c"},
        {"conversations": [turn("user", "only")]},
        {"id": "ready", "prompt": "p", "ground_truth": "g"},
    ]
    (tmp_path / "chats.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = {r["prompt"]: r for r in job_source.scan_chat_jobs(spark, str(tmp_path / "chats.jsonl")).collect()}
    assert tuple(rows["u2"]) == ("x", "u2", "a1", "worfbench", "c")
    assert rows["only"]["ground_truth"] == "" and rows["only"]["id"].startswith("worf_")
    assert tuple(rows["p"]) == ("ready", "p", "g", None, None)


def test_append_keeps_old_rows_and_adds_columns(spark, tmp_path):
    first = spark.createDataFrame([("1", "p", "s", True)], "sample_id string, policy_name string, benchmark string, exact_match boolean")
    second = spark.createDataFrame([("2", "p", "s", 0.5)], "sample_id string, policy_name string, benchmark string, rouge_l double")
    path = str(tmp_path / "results")
    store.append_results(first, path)
    store.append_results(second, path)
    rows = {r["sample_id"]: r for r in store.scan_results(spark, path).collect()}
    assert rows["1"]["exact_match"] == 1.0 and rows["1"]["rouge_l"] is None and rows["2"]["rouge_l"] == 0.5
    assert store.scan_results(spark, path).columns == RESULTS.fieldNames()


def test_csv_survives_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([('say "hi",\nthen go',)], "prompt string")
    store.export_csv(df, str(tmp_path / "csv"))
    assert store.scan_csv(spark, str(tmp_path / "csv"), df.schema).first()["prompt"] == 'say "hi",\nthen go'


def test_missing_summary_is_empty(spark):
    assert store.scan_summary(spark, "never_built", JOB).count() == 0


def test_small_side_checks_the_size(spark):
    df = spark.range(10)
    assert "ResolvedHint" in small_side(df, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(df, 9)._jdf.queryExecution().analyzed().toString()


def test_limit_never_loses_small_suites(spark, sf_dir):
    jobs = suite_jobs(spark, sf_dir)
    assert reports.limit_per_source(jobs, "benchmark", "sample_id").count() == jobs.count()


# --- streams ----------------------------------------------------------------------------


def test_streamed_timings_equal_batch(spark, sf_dir, tmp_path):
    from scoreloom.catalog.streams import arriving

    stream = flows.stream_generation_metrics(chunks_from(arriving(spark, sf_dir, "events")))
    flows.append_files(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    batch = generation.generation_metrics(chunks_from(table(spark, sf_dir, "events")))
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert streamed.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_restarted_stream_appends_only_new_rows(spark, tmp_path):
    source, out, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    base = store.conform(spark.createDataFrame([("1", "p", "s")], "sample_id string, policy_name string, benchmark string"))
    for number in ("1", "2"):
        base.withColumn("sample_id", F.lit(number)).coalesce(1).write.mode("append").parquet(source)
        stream = flows.stream_distinct_results(spark.readStream.schema(RESULTS).parquet(source))
        flows.append_batches(stream, out, log).awaitTermination()
    assert sorted(r["sample_id"] for r in store.scan_results(spark, out).collect()) == ["1", "2"]


def test_late_rows_count_in_streams(spark, sf_dir, tmp_path):
    from scoreloom.sources.tables import results_from

    cases = [
        ("lineitem", results_from, "timestamp", flows.trend_facts, lambda f: flows.merged_trend(f)),
        ("events", chunks_from, "at", flows.timing_facts, lambda f: flows.merged_timings(f, None)),
    ]
    for name, adapt, order, facts, merged in cases:
        rows = adapt(table(spark, sf_dir, name))
        if order == "at":
            rows = rows.withColumn("at", F.unix_micros("chunk_ts").cast("double"))
        source, out, log = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "log"))
        half = rows.approxQuantile(order, [0.5], 0.0)[0]
        for part in (F.col(order) >= half, F.col(order) < half):
            rows.where(part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows.schema).parquet(source)
            flows.append_facts(stream, facts, out, log).awaitTermination()
        streamed = merged(spark.read.parquet(out))
        assert spark.read.parquet(out).select("batch_id").distinct().count() == 2
        if name == "events":
            batch = generation.generation_metrics(rows)
            assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0
        else:
            assert streamed.agg(F.sum("samples")).first()[0] == rows.count()


# --- benchmark runs ---------------------------------------------------------------------


def test_pieces_are_timed():
    """Asked at 10, a blank piece at 11, content at 12 and 15, the end noticed at 16."""
    ticks = iter([12.0, 16.0])
    made = generation.timed(iter(["", "two w", "", "ords", " "]), 10.0, lambda: next(ticks))
    assert (made["response"], made["total_tokens"], made["error"]) == ("two words ", 2, None)
    assert (made["first_token_latency"], made["avg_token_latency"]) == (2.0, 2.0)
    assert (made["generation_time"], made["throughput"]) == (6.0, 2 / 6)
    ticks = iter([3.0])
    silent = generation.timed([], 3.0, lambda: next(ticks))
    assert [silent[k] for k in ("response", "first_token_latency", "avg_token_latency", "throughput", "total_tokens")] == ["", 0.0, 0.0, 0.0, 0]


def test_generator_rows_have_every_metric_or_an_error(spark):
    calls = spark.createDataFrame([("a", "one two", "early_exit_28"), ("b", "bad", "early_exit_28")], "sample_id string, prompt string, policy_name string")

    def generate(prompt, request):
        for word in prompt.split():
            if word == "bad":
                raise ValueError("in the middle")
            yield word + " "

    rows = {r["sample_id"]: r for r in generation.apply_generator(calls, generate).collect()}
    timed = ("first_token_latency", "avg_token_latency", "generation_time", "throughput", "total_tokens", "policy_overhead")
    assert rows["a"]["response"] == "one two " and all(rows["a"][k] is not None for k in timed) and rows["a"]["policy_overhead"] == 0.02
    assert all(rows["b"][k] is None for k in (*timed, "response")) and rows["b"]["error"] == "ValueError: in the middle"


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    """The generator's process dies in the third slice; the next run calls it for what is not stored, and only that."""
    log, path = tmp_path / "calls", str(tmp_path / "table")
    log.mkdir()
    jobs = spark.createDataFrame([(f"s{k}", "crmarena", f"prompt {k}", "truth") for k in range(12)], "sample_id string, benchmark string, prompt string, ground_truth string")
    chosen = [p for p in POLICIES if p.name.startswith("early_exit")]
    slot = F.pmod(F.xxhash64("sample_id", "policy_name", "benchmark"), F.lit(4))
    fatal = jobs.withColumn("policy_name", F.lit("early_exit_28")).where(slot == 2).first()["sample_id"]
    stop = tmp_path / "stop"
    stop.touch()
    log_dir, stop_file = str(log), str(stop)

    def generate(prompt, request):
        import os
        import uuid

        if os.path.exists(stop_file) and request["sample_id"] == fatal:
            os._exit(1)
        open(f"{log_dir}/{request['sample_id']}.{request['policy_name']}.{uuid.uuid4().hex}", "w").close()
        return "an answer"

    with pytest.raises(Exception):  # noqa: B017 - whatever a lost Python process turns into
        benchmark.run_benchmark(jobs, generate, path, chosen, slices=4)
    before = {p.name.rsplit(".", 1)[0] for p in log.iterdir()}
    held = {f"{r['sample_id']}.{r['policy_name']}" for r in store.scan_results(spark, path).collect()}
    assert held and held < {f"s{k}.{p.name}" for k in range(12) for p in chosen}
    stop.unlink()
    for p in log.iterdir():
        p.unlink()
    table = benchmark.run_benchmark(jobs, generate, path, chosen, slices=4)
    after = sorted(p.name.rsplit(".", 1)[0] for p in log.iterdir())
    assert len(after) == len(set(after)) == 24 - len(held) and not set(after) & held and held <= before
    assert table.count() == table.select("sample_id", "policy_name").distinct().count() == 24
    assert benchmark.pending(benchmark.plan_requests(jobs, chosen), path).count() == 0


def test_failed_requests_wait_for_a_retry(spark, tmp_path):
    path = str(tmp_path / "table")
    jobs = spark.createDataFrame([("a", "crmarena", "p", "t")], "sample_id string, benchmark string, prompt string, ground_truth string")

    def fail(prompt, request):
        raise RuntimeError("busy")

    one = [POLICIES[0]]
    assert benchmark.run_benchmark(jobs, fail, path, one, attempts=1, slices=1).first()["error"] == "RuntimeError: busy"
    assert benchmark.run_benchmark(jobs, lambda p, r: "x", path, one, slices=1).count() == 1
    again = benchmark.run_benchmark(jobs, lambda p, r: "x", path, one, slices=1, retry_failed=True)
    assert again.where("error IS NULL AND f1 IS NOT NULL").count() == 1 and again.count() == 2


def test_refreshed_mart_equals_a_rebuilt_one(spark, sf_dir, tmp_path):
    path = str(tmp_path / "mart")
    staged = stage_results(results(spark, sf_dir))
    runs = staged.withColumn("run", F.year("run_date").cast("string"))
    incremental.refresh(runs.where("run < 1998"), path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "mart").rglob("*.parquet")}
    incremental.refresh(runs, path)
    assert files and all(p.stat().st_mtime_ns == t for p, t in files.items())
    shape = lambda df: df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))
    assert same_rows(shape(incremental.merged_stats(spark, path)), shape(mart.policy_stats(staged)))


def test_summary_tells_when_it_was_made(spark, sf_dir):
    stats = stage_results(results(spark, sf_dir)).groupBy(*mart.GROUP).agg(*mart.plain_statistics())
    made = mart.build_summary(stats)
    assert dict(made.dtypes)["summary_generated_at"] == "timestamp"
    assert made.select((F.current_timestamp() - F.col("summary_generated_at") < F.expr("INTERVAL 1 HOUR")).alias("new")).distinct().collect() == [(True,)]


def test_a_late_redelivery_is_found_in_the_table(spark, tmp_path):
    """Batches of one stream, a replay by another stream days later, and rows that are new among old ones."""
    rows = [(f"s{k}", "p", "b", float(k)) for k in range(6)]
    schema = "sample_id string, policy_name string, benchmark string, throughput double"
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    arrive = lambda some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
    go = lambda log: flows.append_unseen(spark.readStream.schema(schema).parquet(source), path, f"{tmp_path}/{log}").awaitTermination()
    arrive(rows[:3] + rows[:1])
    go("one")
    arrive(rows[1:5])
    go("one")
    go("two")
    arrive(rows)
    go("two")
    assert sorted(r["sample_id"] for r in store.scan_results(spark, path).collect()) == [r[0] for r in rows]

"""What a step must not grow by: whole rows shuffled, files that one task must read, files without number."""

import pathlib

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.quality import score_pairs
from scoreloom.plans import reports
from scoreloom.sources import results as store
from scoreloom.streaming import flows

KEYS = ["sample_id", "policy_name", "benchmark"]


def rows(spark, n, parts=1):
    return spark.range(0, n, 1, parts).selectExpr(
        "concat('s', id) AS sample_id", "'greedy' AS policy_name", "'crmarena' AS benchmark", "concat('r', id % 7) AS response"
    )


def files(path, kind):
    return list(pathlib.Path(path).rglob(f"part-*.{kind}"))


def test_rows_are_appended_by_the_tasks_that_have_them(spark, tmp_path):
    path = str(tmp_path / "table")
    store.append_results(rows(spark, 90, 3), path)
    store.append_results(rows(spark, 90, 3), path)
    # Shuffled by policy and suite, each of the two appends would leave one file.
    assert len(files(path, "parquet")) == 6
    assert store.scan_results(spark, path).count() == 180


def test_csv_comes_in_small_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    store.export_csv(rows(spark, 60_000), path)
    assert len(files(path, "csv")) == 3
    assert spark.read.option("header", True).csv(path).distinct().count() == 60_000


def test_unique_texts_in_one_exchange_of_digests(spark):
    some = spark.createDataFrame(
        [("a", "x", None), ("a", "", None), ("b", None, None), (None, "x", None)],
        "prompt STRING, response STRING, ground_truth STRING",
    )
    report = reports.uniqueness_report(some)
    assert tuple(report.first()) == (2, 2, 0)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(params=[0, 2, 100])
def few(request, monkeypatch):
    monkeypatch.setattr(flows, "BROADCAST_ROWS", request.param)


def test_unseen_rows(spark, few):
    schema = "sample_id STRING, policy_name STRING, benchmark STRING, response STRING"
    names = ["s1", "s2", "s2", "s3", "s4", "s5", None, None]
    arrived = spark.createDataFrame([(n, "greedy", "crmarena", "r") for n in names], schema)
    seen = spark.createDataFrame([(n, "greedy", "crmarena") for n in ("s3", "s9", "s3", None)], schema.rsplit(",", 1)[0])

    def left(*found):
        return sorted((r.sample_id or "") for r in flows.unseen(arrived, *found).collect())

    assert left(None) == ["", "s1", "s2", "s3", "s4", "s5"]
    assert left(seen) == ["", "s1", "s2", "s4", "s5"]
    assert left(arrived.where("sample_id IS NOT NULL").select(*KEYS)) == [""]


def test_rows_that_come_once_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(flows, "BROADCAST_ROWS", 5)
    arrived = rows(spark, 30, 3)
    seen = rows(spark, 4).select(F.concat(F.lit("old"), "sample_id").alias("sample_id"), *KEYS[1:])
    assert flows.unseen(arrived, seen) is arrived
    again = flows.unseen(arrived, rows(spark, 4).select(*KEYS))
    assert again.count() == 26
    plan = flows.unseen(arrived, rows(spark, 4).select(*KEYS)).select("response")
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_an_unseen_batch_is_not_held_in_memory(spark, tmp_path, monkeypatch):
    schema = "sample_id STRING, policy_name STRING, benchmark STRING, response STRING"
    source, path, held, computed = str(tmp_path / "in"), str(tmp_path / "table"), [], spark.sparkContext.accumulator(0)
    before, judge = {r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()}, flows.unseen

    def looking(arrived, seen):
        held.extend(r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo() if r.id() not in before)
        return judge(arrived, seen)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(flows, "unseen", looking)
    monkeypatch.setattr(flows, "BROADCAST_ROWS", 5)
    rows(spark, 40, 2).unionByName(rows(spark, 3).withColumn("benchmark", F.lit(None).cast("string"))).write.parquet(source)
    for log in ("one", "two", "three"):
        if log == "three":
            # Some rows twice, and what a broken attempt left.
            rows(spark, 80, 2).unionByName(rows(spark, 50, 2)).write.mode("overwrite").parquet(source)
            rows(spark, 9).write.parquet(f"{path}/_staged-0")
        stream = spark.readStream.schema(schema).parquet(source).mapInArrow(counted, schema)
        flows.append_unseen(stream, path, str(tmp_path / log)).awaitTermination()
        assert not list(pathlib.Path(path).glob("_staged*"))
    assert not held
    # Each row of the three deliveries once.
    assert computed.value == 43 + 43 + 130
    stored = store.scan_results(spark, path)
    # A batch replaces what a batch of its number wrote: the last delivery's replaces both before it.
    assert stored.where("benchmark IS NOT NULL").distinct().count() == stored.count() == 80


def test_a_stateful_batch_leaves_few_files(spark, tmp_path):
    rows(spark, 2_000, 2).write.parquet(str(tmp_path / "in"))
    former = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        schema = "sample_id STRING, policy_name STRING, benchmark STRING, response STRING"
        stream = flows.stream_distinct_results(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        path = str(tmp_path / "out")
        flows.append_batches(stream, path, str(tmp_path / "log")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", former)
    assert store.scan_results(spark, path).count() == 2_000
    assert 0 < len(files(path, "parquet")) <= flows.TURNS * spark.sparkContext.defaultParallelism


def test_scores_take_the_lower_case_of_a_text_once(spark):
    pairs = spark.createDataFrame(
        [("crmarena", "CANNOT help: Sorry!", "i cannot help"), ("worfbench", "First, 1) CONSIDER", None)],
        "benchmark STRING, response STRING, ground_truth STRING",
    )
    scored = score_pairs(pairs)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    first = scored.where("benchmark = 'crmarena'").first()
    # can, not, help, :, Sorry, !
    assert (first.prediction_length, first.reference_length, first.customer_service_coverage) == (6, 4, 1.0)

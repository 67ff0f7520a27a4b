"""Files in and out: odd texts, broken lines, and tables of several files."""

import pytest
from pyspark.sql import functions as F

from scoreloom.catalog.streams import arriving
from scoreloom.schemas import RESULTS
from scoreloom.sources import jobs, results
from scoreloom.sources.tables import table

TEXTS = ["  lead and trail  ", "\n code\n", "", None, "a\r\nb", 'say "x", y', "\\N", "\\\\N", "\\", "\t", '""', "é"]


def test_csv_keeps_every_text(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "sample_id string, response string")
    results.export_csv(results.conform(rows), f"{tmp_path}/csv")
    back = results.scan_csv(spark, f"{tmp_path}/csv", RESULTS)
    assert back.columns == RESULTS.fieldNames()
    assert {int(r["sample_id"]): r["response"] for r in back.collect()} == dict(enumerate(TEXTS))
    assert back.where("prompt IS NULL AND throughput IS NULL").count() == len(TEXTS)


def test_csv_keeps_whole_results(spark, sf_dir, tmp_path):
    from scoreloom.sources.tables import results as made

    rows = made(spark, sf_dir)
    results.export_csv(rows, f"{tmp_path}/csv")
    back = results.scan_csv(spark, f"{tmp_path}/csv", RESULTS)
    order = lambda df: sorted(map(repr, df.select(RESULTS.fieldNames()).collect()))
    assert order(back) == order(rows)


def test_compressed_csv_keeps_every_text(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "sample_id string, response string")
    results.export_csv(results.conform(rows), f"{tmp_path}/csv", "gzip")
    back = results.scan_csv(spark, f"{tmp_path}/csv", RESULTS)
    assert {int(r["sample_id"]): r["response"] for r in back.collect()} == dict(enumerate(TEXTS))


def test_exported_results_take_little_disk(spark, sf_dir, monkeypatch, tmp_path):
    from scoreloom.catalog import runs
    from scoreloom.sources.tables import results as made

    monkeypatch.setattr(runs, "scratch", lambda session, name: f"{tmp_path}/{name}")
    exported = runs.export_csv(spark, sf_dir)
    results.export_csv(made(spark, sf_dir), f"{tmp_path}/plain")
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).glob("part-*"))
    assert 0 < size("csv") < size("plain") / 3
    assert exported.count() == made(spark, sf_dir).count()


LINES = """{"sample_id": "a", "prompt": "p", "ground_truth": "g", "metadata": {"k": "v"}}
{"id": "b", "prompt": "p", "ground_truth": "g"}
{"prompt": "p", "ground_truth": "g"}
not json
"""
CHATS = """{"id": "a", "conversations": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}
{"id": "b", "prompt": "p", "ground_truth": "g"}
[broken
"""


def test_jobs_keyed_by_id_and_rejects(spark, tmp_path):
    (tmp_path / "jobs.jsonl").write_text(LINES)
    scanned = jobs.scan_jobs(spark, f"{tmp_path}/jobs.jsonl")
    assert scanned.count() == 4 and jobs.good_jobs(scanned).count() == 2
    assert {r["sample_id"] for r in jobs.good_jobs(scanned).collect()} == {"a", "b"}
    assert sorted(r["reject"] for r in jobs.rejected_jobs(scanned).collect()) == ["not a JSON object", "sample_id is missing"]


def test_chats_can_be_counted_and_rejects_are_kept(spark, tmp_path):
    (tmp_path / "chats.jsonl").write_text(CHATS)
    path = f"{tmp_path}/chats.jsonl"
    assert jobs.scan_chat_jobs(spark, path).count() == 2
    assert {r["id"]: r["prompt"] for r in jobs.scan_chat_jobs(spark, path).collect()} == {"a": "q", "b": "p"}
    assert [tuple(r) for r in jobs.rejected_chats(spark, path).collect()] == [("[broken", "not a JSON object")]
    assert jobs.rejected_chats(spark, path).count() == 1


def test_extra_columns_of_the_results_table_can_be_read(spark, tmp_path):
    from pyspark.sql import types as T

    path, extra = f"{tmp_path}/r", T.StructType([T.StructField("my_metric", T.DoubleType())])
    key = {"sample_id": "a", "policy_name": "p", "benchmark": "b"}
    results.append_results(spark.createDataFrame([key]), path)
    results.append_results(spark.createDataFrame([{**key, "my_metric": 0.5}]), path)
    assert results.scan_results(spark, path).columns == RESULTS.fieldNames()
    found = [r["my_metric"] for r in results.scan_results(spark, path, extra).collect()]
    assert sorted(found, key=str) == [0.5, None]


@pytest.mark.parametrize("parts", [1, 4])
def test_a_folder_of_files_streams_like_one_file(spark, sf_dir, tmp_path, parts):
    rows = table(spark, sf_dir, "events")
    rows.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (sf_dir, str(tmp_path)):
        stream = arriving(spark, folder, "events")
        query = (
            stream.groupBy().agg(F.count("*").alias("n")).writeStream.format("memory").queryName("seen")
            .outputMode("complete").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert spark.table("seen").first()["n"] == rows.count()


def test_undeclared_columns_of_any_run_are_found(spark, tmp_path):
    path = f"{tmp_path}/r"
    key = {"sample_id": "a", "policy_name": "p", "benchmark": "b"}
    results.append_results(spark.createDataFrame([key]), path)
    results.append_results(spark.createDataFrame([{**key, "zeta": 0.5}]), path)
    results.append_results(spark.createDataFrame([{**key, "alpha": [1]}]), path)
    found = results.scan_open_results(spark, path)
    assert found.columns == [*RESULTS.fieldNames(), "alpha", "zeta"] and found.schema[: len(RESULTS)] == RESULTS
    assert sorted(map(repr, (tuple(r) for r in found.select("alpha", "zeta").collect()))) == ["(None, 0.5)", "(None, None)", "([1], None)"]
    assert results.stored_keys(spark, path).count() == 3 and results.stored_keys(spark, f"{tmp_path}/no") is None


def test_one_write_routes_good_and_rejected_rows(spark, tmp_path):
    (tmp_path / "jobs.jsonl").write_text(LINES)
    scanned = jobs.scan_jobs(spark, f"{tmp_path}/jobs.jsonl")
    results.write_routed(scanned, F.col("reject"), f"{tmp_path}/routed")
    good = results.scan_routed(spark, f"{tmp_path}/routed", scanned.schema, "good")
    assert {r["sample_id"] for r in good.collect()} == {"a", "b"} and good.columns == scanned.columns
    assert "route=good" not in good._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[0]
    rejected = results.scan_routed(spark, f"{tmp_path}/routed", scanned.schema, "rejected")
    assert sorted((r["reject"], r["_corrupt"]) for r in rejected.collect()) == sorted((r["reject"], r["_corrupt"]) for r in jobs.rejected_jobs(scanned).collect())
    assert results.scan_routed(spark, f"{tmp_path}/routed", scanned.schema).groupBy("route").count().count() == 2


def test_documents_without_an_item_are_paired_with_nothing(spark, tmp_path):
    from scoreloom.sources.tables import text_pairs

    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (-1, "d"), (None, "e"), (5, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x"), (2, "z"), (7, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["response"]: r["ground_truth"] for r in text_pairs(spark, str(tmp_path)).collect()}
    assert found == {"a": "x", "b": None, "c": "z", "d": "z", "e": None, None: "z"}

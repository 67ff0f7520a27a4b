"""Adapters that read the supplied star-schema tables as results, jobs, texts and chunk logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.plans.generation import policy_overhead
from scoreloom.plans.policies import POLICIES
from scoreloom.schemas import RESULTS
from scoreloom.session import spread
from scoreloom.sources.jobs import fold_turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Result columns as expressions over a line item; first, predicted and expected are
# written out where other columns need them.
_FIRST = "0.02D + 10 * l_discount"
_PREDICTED, _EXPECTED = "CAST(l_quantity AS BIGINT) + 5", "20 + CAST(l_linenumber AS BIGINT)"
_METRICS = {
    "first_token_latency": _FIRST,
    "avg_token_latency": "0.001D * (1 + l_linenumber) + l_tax / 10",
    "generation_time": f"{_FIRST} + l_quantity / 20",
    "policy_overhead": policy_overhead("policy_name"),
    "throughput": "4 * l_quantity",
    "total_tokens": "CAST(8 * l_quantity AS BIGINT)",
    "exact_match": "IF(l_tax >= 0.075D, 1D, 0D)",
    "precision": "10 * l_tax + l_discount",
    "recall": "8 * l_tax + 2 * l_discount",
    "f1": "12.5D * l_tax",
    "rouge_1": "11 * l_tax",
    "rouge_2": "6 * l_tax",
    "rouge_l": "9 * l_tax + l_discount",
    "semantic_similarity": "5 * l_tax + 5 * l_discount",
    "prediction_length": _PREDICTED,
    "reference_length": _EXPECTED,
    "length_ratio": f"CAST({_PREDICTED} AS DOUBLE) / ({_EXPECTED})",
    "length_difference": f"abs({_PREDICTED} - ({_EXPECTED}))",
    "customer_service_coverage": "10 * l_discount",
    "sales_coverage": "9 * l_discount",
    "support_coverage": "12.5D * l_tax",
    "retention_coverage": "6 * l_tax",
    "overall_keyword_coverage": "5 * l_discount + 5 * l_tax",
    "analytical_coverage": "8 * l_discount",
    "structure_coverage": "4 * l_tax",
    "reasoning_depth": "(8 * l_discount + 4 * l_tax) / 2",
}
_NAMES = ", ".join(f"'{p.name}'" for p in POLICIES)
_SHIPPED = "unix_seconds(CAST(l_shipdate AS TIMESTAMP))"
_PLAIN = {
    "sample_id": "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    f"CAST(floor({_SHIPPED} / 86400) AS BIGINT))",
    "policy_name": "policy_name",
    "benchmark": "IF(l_partkey % 2 = 0, 'crmarena', 'worfbench')",
    "prompt": "concat('Question about part ', l_partkey)",
    "response": "concat('Supplier ', l_suppkey, ' ships part ', l_partkey)",
    "ground_truth": "concat('Part ', l_partkey, ' is available')",
    "timestamp": f"CAST({_SHIPPED} AS DOUBLE) + (l_partkey % 24) * 3600 + 0.25D",
    "error": "IF(l_linenumber = 7, 'timeout', NULL)",
}


def results_from(lineitem: DataFrame) -> DataFrame:
    """One result per line item; lines numbered 7 are failed samples without metrics."""
    measured = {name: f"IF(l_linenumber = 7, NULL, {sql})" for name, sql in _METRICS.items()}
    columns = {**_PLAIN, **measured}
    policy = f"array({_NAMES})[CAST(l_suppkey % {len(POLICIES)} AS INT)]"
    return lineitem.selectExpr("*", f"{policy} AS policy_name").selectExpr(
        *(
            f"CAST({columns[f.name]} AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in RESULTS
        )
    )


def results(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """heavy=True spreads a small table over all cores, for costly per-row work."""
    lines = table(spark, sf_dir, "lineitem")
    return results_from(spread(lines, "l_orderkey") if heavy else lines)


def chat_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_turns(table(spark, sf_dir, "conversations"))


def suite_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded conversations as jobs of two suites."""
    suite = F.when(F.col("conv_id") % 2 == 0, "crmarena").otherwise("worfbench")
    return chat_jobs(spark, sf_dir).select(
        F.col("id").alias("sample_id"), suite.alias("benchmark"), "prompt", "ground_truth"
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against benchmark items, and last user turn against last answer."""
    items = table(spark, sf_dir, "benchmark")
    count = F.lit(items.count())
    documents = (
        spread(table(spark, sf_dir, "documents"), "doc_id")
        # A document whose number no item has is paired with NULL, not lost.
        .withColumn("item_id", F.when(count > 0, F.pmod("doc_id", F.greatest(count, F.lit(1)))))
        .join(items.withColumnRenamed("text", "ground_truth"), "item_id", "left")
        .select(
            F.concat(F.lit("d"), "doc_id").alias("sample_id"),
            F.when(F.col("doc_id") % 2 == 0, "crmarena").otherwise("worfbench").alias("benchmark"),
            F.col("text").alias("response"),
            "ground_truth",
        )
    )
    chats = chat_jobs(spark, sf_dir).select(
        F.concat(F.lit("c"), "conv_id").alias("sample_id"),
        F.when(F.col("conv_id") % 2 == 0, "crmarena").otherwise("worfbench").alias("benchmark"),
        F.col("prompt").alias("response"),
        "ground_truth",
    )
    return documents.unionByName(chats)


def text_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every pair: sample_id, benchmark, side, text."""
    sides = F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in ("response", "ground_truth")))
    return text_pairs(spark, sf_dir).select("sample_id", "benchmark", F.inline(sides))


def chunks_from(events: DataFrame) -> DataFrame:
    """A chunk log: one request per user and day, started at midnight; errors are blank chunks."""
    stamp = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", stamp)
    return events.select(
        F.concat_ws("/", "user_id", F.date_format(day, "yyyy-MM-dd")).alias("request_id"),
        day.alias("started_at"),
        stamp.alias("chunk_ts"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("content"),
    )

"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


JOB = T.StructType(
    _fields(T.StringType(), "sample_id prompt ground_truth")
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)

TURN = T.StructType(_fields(T.StringType(), "role content"))

CHAT_JOB = T.StructType(
    _fields(T.StringType(), "id prompt ground_truth source category")
    + [T.StructField("conversations", T.ArrayType(TURN))]
)

CRM_COLUMNS = (
    "customer_service_coverage sales_coverage support_coverage retention_coverage "
    "overall_keyword_coverage"
).split()
WORF_COLUMNS = "analytical_coverage structure_coverage reasoning_depth".split()
SUITE_COLUMNS = {"crmarena": CRM_COLUMNS, "worfbench": WORF_COLUMNS}

RESULTS = T.StructType(
    _fields(T.StringType(), "sample_id policy_name benchmark prompt response ground_truth")
    + _fields(
        T.DoubleType(),
        "timestamp first_token_latency avg_token_latency generation_time policy_overhead throughput",
    )
    + _fields(T.LongType(), "total_tokens")
    + _fields(
        T.DoubleType(),
        "exact_match precision recall f1 rouge_1 rouge_2 rouge_l semantic_similarity",
    )
    + _fields(T.LongType(), "prediction_length reference_length")
    + _fields(T.DoubleType(), "length_ratio")
    + _fields(T.LongType(), "length_difference")
    + _fields(T.DoubleType(), " ".join(CRM_COLUMNS + WORF_COLUMNS))
    + _fields(T.StringType(), "error")
)

RESULT_KEYS = ["sample_id", "policy_name", "benchmark"]

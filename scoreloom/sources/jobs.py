"""Benchmark jobs: JSON lines in and out, chat transcripts, and template expansion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.schemas import CHAT_JOB, JOB

CORRUPT = "_corrupt"
REQUIRED = ["sample_id", "prompt", "ground_truth"]


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema.add(CORRUPT, T.StringType()))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def scan_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs from JSON lines; `reject` names why a line cannot be used, NULL for good lines.

    A line keyed by `id` instead of `sample_id` is as good.
    """
    jobs = _read_json(spark, path, T.StructType([*JOB.fields, T.StructField("id", T.StringType())]))
    jobs = jobs.withColumn("sample_id", F.coalesce("sample_id", "id"))
    reason = F.when(F.col(CORRUPT).isNotNull(), "not a JSON object")
    for key in REQUIRED:
        reason = reason.when(F.col(key).isNull(), f"{key} is missing")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return jobs.select(
        *REQUIRED,
        F.coalesce("metadata", empty).alias("metadata"),
        CORRUPT,
        reason.alias("reject"),
    )


def good_jobs(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("reject").isNull()).select(JOB.fieldNames())


def rejected_jobs(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("reject").isNotNull())


def scan_chat_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Chat transcripts (or ready jobs) from JSON lines, folded to one job per line.

    Lines that are no JSON objects, or have none of the keys, are left to :func:`rejected_chats`.
    """
    return fold_nested_turns(_chats(spark, path).where("reject IS NULL"))


def rejected_chats(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines that cannot be read, with the reason."""
    return _chats(spark, path).where("reject IS NOT NULL").select(CORRUPT, "reject")


def _chats(spark: SparkSession, path: str) -> DataFrame:
    names = CHAT_JOB.fieldNames()
    read = _read_json(spark, path, T.StructType(list(CHAT_JOB.fields)))
    nothing = F.coalesce(*(F.col(c).cast("string") for c in names)).isNull()
    reason = F.when(F.col(CORRUPT).isNotNull(), "not a JSON object").when(nothing, "no known key")
    return read.withColumn("reject", reason)


def _last_of(role: str) -> Column:
    said = F.filter("conversations", lambda turn: turn["role"] == role)
    return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], F.lit(""))


def fold_nested_turns(chats: DataFrame) -> DataFrame:
    """Prompt is the last user turn, ground truth the last assistant turn, '' without one.

    Lines without turns pass through. A line without id gets one from its content.
    """
    chat = F.col("conversations").isNotNull()

    def when_chat(value: Column, name: str) -> Column:
        return F.when(chat, value).otherwise(F.col(name)).alias(name)

    made_up = F.format_string("worf_%016x", F.xxhash64(F.to_json(F.struct("conversations"))))
    return chats.select(
        when_chat(F.coalesce("id", made_up), "id"),
        when_chat(_last_of("user"), "prompt"),
        when_chat(_last_of("assistant"), "ground_truth"),
        when_chat(F.coalesce("source", F.lit("worfbench")), "source"),
        when_chat(F.coalesce("category", F.lit("eval")), "category"),
    )


def fold_turns(turns: DataFrame) -> DataFrame:
    """The same for a long table (conv_id, turn, role, text): one partial aggregate per row."""

    def last(role: str, name: str) -> Column:
        order = F.when(F.col("role") == role, F.col("turn"))
        return F.coalesce(F.max_by("text", order), F.lit("")).alias(name)

    return (
        turns.groupBy("conv_id")
        .agg(last("user", "prompt"), last("assistant", "ground_truth"))
        .select(
            "conv_id",
            F.concat(F.lit("worf_"), F.col("conv_id")).alias("id"),
            "prompt",
            "ground_truth",
            F.lit("worfbench").alias("source"),
            F.lit("eval").alias("category"),
        )
    )


def write_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Template:
    """A job pattern; {date} and {expected_date} in the prompt are filled per job."""

    prompt: str
    ground_truth: str
    category: str


DIFFICULTY = ["easy", "medium", "hard"]
LEVEL = ["low", "medium", "high"]


def _pick(options: Sequence[str], index: Column) -> Column:
    choices = F.array(*(F.lit(option) for option in options))
    return F.get(choices, F.pmod(index, F.lit(len(options))).cast("int"))


def expand_templates(
    seeds: DataFrame,
    number: str,
    ordered_on: str,
    templates: Sequence[Template],
    benchmark: str,
) -> DataFrame:
    """One job per seed row; every choice is plain arithmetic on the row's number.

    The few templates travel inside the plan as a literal, so there is no join.
    """
    n = F.col(number)
    pick = F.pmod(n * 7 + 3, F.lit(len(templates))).cast("int")
    table = F.array(
        *(
            F.struct(
                F.lit(t.prompt).alias("prompt"),
                F.lit(t.ground_truth).alias("ground_truth"),
                F.lit(t.category).alias("category"),
            )
            for t in templates
        )
    )
    chosen = F.get(table, pick)
    day = F.to_date(ordered_on)
    expected = F.date_add(day, (F.pmod(n, F.lit(6)) + 2).cast("int"))
    prompt = F.replace(
        F.replace(chosen["prompt"], F.lit("{date}"), F.date_format(day, "yyyy-MM-dd")),
        F.lit("{expected_date}"),
        F.date_format(expected, "yyyy-MM-dd"),
    )
    if benchmark == "crmarena":
        prefix, second, third = "crm", ("difficulty", _pick(DIFFICULTY, n)), (
            "priority",
            _pick(LEVEL, F.floor(n / 3)),
        )
    else:
        prefix, second, third = "worf", ("complexity", _pick(LEVEL, n)), (
            "domain",
            F.split_part(chosen["category"], F.lit("_"), F.lit(1)),
        )
    return seeds.select(
        F.concat(
            F.lit(f"{prefix}_"),
            F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")),
        ).alias("sample_id"),
        prompt.alias("prompt"),
        chosen["ground_truth"].alias("ground_truth"),
        F.create_map(
            F.lit("category"),
            chosen["category"],
            F.lit(second[0]),
            second[1],
            F.lit(third[0]),
            third[1],
        ).alias("metadata"),
    )

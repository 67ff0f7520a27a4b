"""The policy registry and the request parameters each policy asks for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS, TEMPERATURE, TOP_P = 1024, 0.7, 1.0
LAYERS = 32
# The registry is configuration: a list in the program, joined as a literal or broadcast.


@dataclass(frozen=True)
class Policy:
    """One policy; None falls back to the common default."""

    name: str
    defaults: dict[str, str] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)
    max_tokens: int | None = None
    temperature: float | None = None
    top_p: float | None = None


def _policy(name: str, **params: object) -> Policy:
    text = {key: str(value) for key, value in params.items()}
    return Policy(name, defaults=text)


# Registered policies, their parameters and their overhead in seconds.
POLICIES = [
    _policy("speculative_decoding", look_ahead_tokens=1),
    _policy("speculative_decoding_4token", look_ahead_tokens=4),
    _policy("dynamic_pruning_top_p", variant="top_p", top_p=0.9),
    _policy("dynamic_pruning_entropy", variant="entropy_threshold", entropy_threshold=2.0),
    _policy("early_exit_28", exit_layer=28),
    _policy("early_exit_32", exit_layer=32),
    _policy("adaptive_kv_static", variant="static", cache_ratio=0.8),
    _policy("adaptive_kv_cosine", variant="cosine", cache_ratio=0.8),
    _policy("elastic_batch_greedy", variant="greedy", batch_size=4),
    _policy("elastic_batch_sorted", variant="sorted", batch_size=4),
]
OVERHEAD = {
    "speculative": 0.1,
    "dynamic_pruning": 0.05,
    "early_exit": 0.02,
    "adaptive_kv": 0.03,
    "elastic_batch": 0.15,
}
FAMILIES = {
    "speculative": "Speculative Decoding",
    "dynamic_pruning": "Dynamic Token Pruning",
    "early_exit": "Early Exit",
    "adaptive_kv": "Adaptive KV-Cache",
    "elastic_batch": "Elastic Batch Repacking",
}

_SCHEMA = (
    "policy_name string, max_tokens int, temperature double, top_p double, "
    "defaults map<string,string>, params map<string,string>"
)


def policy_table(spark: SparkSession, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    rows = [(p.name, p.max_tokens, p.temperature, p.top_p, p.defaults, p.params) for p in policies]
    return spark.createDataFrame(rows, _SCHEMA)


def cross_policies(jobs: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Every job under every policy: the names are exploded in place, nothing is joined."""
    names = F.array(*(F.lit(p.name) for p in policies))
    return jobs.select("*", F.explode(names).alias("policy_name"))


def flag_known(df: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """A column `known`: is the row's policy in the registry?"""
    table = F.broadcast(policy_table(df.sparkSession, policies).select("policy_name", F.lit(True).alias("known")))
    return df.join(table, "policy_name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def known_policies(df: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    table = F.broadcast(policy_table(df.sparkSession, policies).select("policy_name"))
    return df.join(table, "policy_name", "left_semi")


def unknown_policies(df: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    table = F.broadcast(policy_table(df.sparkSession, policies).select("policy_name"))
    return df.join(table, "policy_name", "left_anti")


def resolve_policy_config(df: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Look up each row's policy, fill defaults, and let configured params win over defaults."""
    table = F.broadcast(policy_table(df.sparkSession, policies))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    defaults = F.coalesce("defaults", empty)
    chosen = F.coalesce("params", empty)
    merged = F.map_concat(
        F.map_filter(defaults, lambda key, _: ~F.map_contains_key(F.coalesce("params", empty), key)),
        chosen,
    )
    return df.join(table, "policy_name", "left").select(
        *df.columns,
        F.coalesce("max_tokens", F.lit(MAX_TOKENS)).alias("max_tokens"),
        F.coalesce("temperature", F.lit(TEMPERATURE)).alias("temperature"),
        F.coalesce("top_p", F.lit(TOP_P)).alias("top_p"),
        merged.alias("params"),
    )


def _param(name: str, default: float) -> Column:
    return F.coalesce(F.col("params")[name].cast("double"), F.lit(default))


def _is(prefix: str) -> Column:
    return F.startswith("policy_name", F.lit(prefix))


def effective_parameters(resolved: DataFrame) -> DataFrame:
    """Replace the generation limits by what the policy really sends, and add fan_out."""
    variant = F.col("params")["variant"]
    tokens, ratio = F.col("max_tokens"), _param("cache_ratio", 0.8)
    decay = 0.5 * (1 + F.cos(F.lit(pi) * ratio))
    static = F.coalesce(variant, F.lit("static")) == "static"
    by_top_p = F.coalesce(variant, F.lit("top_p")) == "top_p"
    cooled = F.greatest(
        F.lit(0.1), F.col("temperature") * (_param("entropy_threshold", 2.0) / 3.0)
    )
    return resolved.withColumns(
        {
            "max_tokens": F.when(
                _is("early_exit"), (tokens * (_param("exit_layer", 28) / LAYERS)).cast("int")
            )
            .when(_is("adaptive_kv") & static, (tokens * ratio).cast("int"))
            .when(_is("adaptive_kv"), (tokens * decay).cast("int"))
            .otherwise(tokens),
            "temperature": F.when(_is("dynamic_pruning") & ~by_top_p, cooled).otherwise(
                F.col("temperature")
            ),
            "top_p": F.when(_is("dynamic_pruning") & by_top_p, _param("top_p", 0.9)).otherwise(
                F.col("top_p")
            ),
            "fan_out": F.when(_is("speculative"), _param("look_ahead_tokens", 1) + 1)
            .when(_is("elastic_batch"), _param("batch_size", 4))
            .otherwise(F.lit(1))
            .cast("int"),
        }
    )


def plan_requests(jobs: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Jobs times policies: one row per request with its effective parameters."""
    return effective_parameters(resolve_policy_config(cross_policies(jobs, policies), policies))


def plan_candidates(requests: DataFrame) -> DataFrame:
    """One row per parallel candidate; batch candidates get warmer with their index."""
    index = F.col("candidate")
    warmed = F.least(F.col("temperature") + 0.05 * index, F.lit(1.0))
    return requests.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("fan_out") - 1)).alias("candidate")
    ).withColumn(
        "temperature", F.when(_is("elastic_batch"), warmed).otherwise(F.col("temperature"))
    )

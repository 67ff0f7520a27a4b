"""From chunk logs, candidate tables or a user's generator to responses with timings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.text import word_count
from scoreloom.operators.numbering import number_rows
from scoreloom.plans.policies import OVERHEAD


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def policy_overhead(policy: str) -> str:
    """SQL for the fixed overhead in seconds of the policy named in a column."""
    cases = " ".join(
        f"WHEN startswith({policy}, '{prefix}') THEN {cost}D" for prefix, cost in OVERHEAD.items()
    )
    return f"CASE {cases} ELSE 0D END"


def chunk_aggregates() -> list[Column]:
    """Mergeable facts about the chunks of one request; blank chunks only mark time."""
    spoken = F.coalesce(F.col("content"), F.lit("")) != ""
    return [
        F.min("started_at").alias("started_at"),
        F.min(F.when(spoken, F.col("chunk_ts"))).alias("first_ts"),
        F.max("chunk_ts").alias("end_ts"),
        F.coalesce(F.sum(F.when(spoken, word_count(F.col("content")))), F.lit(0))
        .cast("long")
        .alias("total_tokens"),
    ]


def timings(aggregated: DataFrame, *keep: str) -> DataFrame:
    """Latencies and rates from :func:`chunk_aggregates`; a request without content gets 0."""
    tokens = F.col("total_tokens")
    spoke = F.col("first_ts").isNotNull()
    whole = seconds_between(F.col("started_at"), F.col("end_ts"))
    first = seconds_between(F.col("started_at"), F.col("first_ts"))
    rest = seconds_between(F.col("first_ts"), F.col("end_ts"))
    return aggregated.select(
        *keep,
        F.when(spoke, first).otherwise(F.lit(0.0)).alias("first_token_latency"),
        F.when(spoke, rest / F.greatest(tokens, F.lit(1)))
        .otherwise(F.lit(0.0))
        .alias("avg_token_latency"),
        tokens,
        F.try_divide(tokens.cast("double"), whole).alias("throughput"),
        whole.alias("generation_time"),
    )


def generation_metrics(chunks: DataFrame) -> DataFrame:
    """One row per request from a chunk log; chunks are combined before the shuffle."""
    return timings(chunks.groupBy("request_id").agg(*chunk_aggregates()), "request_id")


def pick_candidate(candidates: DataFrame, request: str, index: str, content: str) -> DataFrame:
    """The first candidate of each request, '' where it failed."""
    first = F.min_by(F.col(content), F.col(index))
    return candidates.groupBy(request).agg(F.coalesce(first, F.lit("")).alias("response"))


def length_buckets(
    jobs: DataFrame,
    batch_size: int,
    suite: str,
    job_id: str,
    length: str | None = None,
) -> DataFrame:
    """Assign batch numbers per suite: in arrival order, or by prompt length to even batches."""
    order = [job_id] if length is None else [length, job_id]
    numbered = number_rows(jobs, [suite], order, "_place")
    batch = F.floor((F.col("_place") - 1) / batch_size).cast("long")
    return numbered.withColumn("batch_id", batch).drop("_place")


Answer = str | Iterable[str]
Generator = Callable[[str, dict[str, Any]], Answer]
GENERATORS: dict[str, Generator] = {}
MADE = (
    "response string, timestamp double, first_token_latency double, avg_token_latency double, "
    "generation_time double, throughput double, total_tokens long, error string"
)


def register_generator(name: str, generate: Generator) -> None:
    """Name a callable generate(prompt, request) -> response, whole or in pieces, for :func:`apply_generator`."""
    GENERATORS[name] = generate


def timed(answer: Answer, started: float, clock: Callable[[], float] = time.monotonic) -> dict[str, Any]:
    """A response and when its pieces came; a whole response is one piece, and blank pieces only take time.

    Tokens are words of the whole response, since a piece may end inside a word. A response
    without content has latencies of 0.
    """
    first, pieces = None, []
    for piece in [answer] if isinstance(answer, str) else answer:
        if piece:
            first = clock() if first is None else first
            pieces.append(piece)
    ended = clock()
    response = "".join(pieces)
    tokens, whole = len(response.split()), ended - started
    return {
        "response": response,
        "timestamp": time.time(),
        "first_token_latency": 0.0 if first is None else first - started,
        "avg_token_latency": 0.0 if first is None else (ended - first) / max(tokens, 1),
        "generation_time": whole,
        "throughput": tokens / whole if whole > 0 else 0.0,
        "total_tokens": tokens,
        "error": None,
    }


def apply_generator(requests: DataFrame, generate: str | Generator, attempts: int = 3) -> DataFrame:
    """Run a user's callable over planned requests in Arrow batches, timing the pieces as they come.

    Times count from the start of the attempt that answered. A request that fails `attempts`
    times becomes a row with `error` set and no metrics; no row is lost. Where requests name a
    policy, its fixed overhead is added as `policy_overhead`.
    """
    call = GENERATORS[generate] if isinstance(generate, str) else generate
    made = T.StructType.fromDDL(MADE)
    names = made.fieldNames()

    def one(request: dict[str, Any]) -> dict[str, Any]:
        error = None
        for _ in range(attempts):
            started = time.monotonic()
            try:
                return timed(call(request["prompt"], request), started)
            except Exception as problem:  # noqa: BLE001 - any failure becomes a row
                error = f"{type(problem).__name__}: {problem}"
        return dict.fromkeys(names) | {"timestamp": time.time(), "error": error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(request) for request in batch.to_dict("records")]
            extra = pd.DataFrame(rows, columns=names, index=batch.index).astype({"total_tokens": "Int64"})
            yield pd.concat([batch, extra], axis=1)

    answered = requests.mapInPandas(run, T.StructType([*requests.schema.fields, *made.fields]))
    if "policy_name" not in requests.columns:
        return answered
    overhead = F.when(F.col("error").isNull(), F.expr(policy_overhead("policy_name")))
    return answered.withColumn("policy_overhead", overhead)

"""A benchmark run from jobs to a stored, scored results table, which can be stopped and started again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.quality import score_pairs
from scoreloom.plans.generation import Generator, apply_generator
from scoreloom.plans.policies import POLICIES, Policy, plan_requests
from scoreloom.schemas import RESULT_KEYS
from scoreloom.sources.results import append_results, scan_open_results, stored_keys

SLICES = 8
# What a request is planned with; the results table keeps what came of it.
PLANNED = ["max_tokens", "temperature", "top_p", "fan_out", "params"]


def pending(requests: DataFrame, path: str, retry_failed: bool = False) -> DataFrame:
    """The requests the table at `path` has no row for; with retry_failed, those it has only failures for as well."""
    done = stored_keys(requests.sparkSession, path)
    if done is None:
        return requests
    if retry_failed:
        done = done.where(F.col("error").isNull())
    return requests.join(done.select(*RESULT_KEYS), RESULT_KEYS, "left_anti")


def run_benchmark(
    jobs: DataFrame,
    generate: str | Generator,
    path: str,
    policies: Sequence[Policy] = POLICIES,
    attempts: int = 3,
    slices: int = SLICES,
    upto: int | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """Plan, generate, score and append every request of `jobs` that the table lacks; returns the table.

    jobs have sample_id, benchmark, prompt and ground_truth. Requests are dealt into `slices` by a
    hash of their key, and each slice is appended as a whole before the next begins, so a run that
    is stopped loses one slice at most. A later call leaves out what is stored before the generator is
    called: no stored request is generated twice. `upto` ends the call after that many
    slices. Failed requests are rows with `error`; they are tried again only with `retry_failed`.
    Requests without sample_id are never found in the table and run each time.
    """
    requests = plan_requests(jobs, policies)
    slot = F.pmod(F.xxhash64(*RESULT_KEYS), F.lit(slices))
    for number in range(slices if upto is None else min(upto, slices)):
        missing = pending(requests.where(slot == number), path, retry_failed)
        answered = apply_generator(missing.drop("params"), generate, attempts)
        append_results(score_pairs(answered).drop(*PLANNED), path)
    return scan_open_results(jobs.sparkSession, path)

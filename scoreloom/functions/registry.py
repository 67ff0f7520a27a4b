"""User metrics, and what each suite does before scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.coverage import crm_coverage, crm_hits, worf_coverage, worf_hits
from scoreloom.functions.text import clean_crm_answer, clean_markdown

PairMetric = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Suite:
    """Cleaning, headline metric, and extra metrics: hits per text, scores from both hits.

    Hits and scores take column names; hits also whether the column is lower case already.
    """

    clean: Callable[[Column], Column]
    headline: str
    hits: Callable[..., Column]
    scores: Callable[[str, str], dict[str, Column]]


SUITES: dict[str, Suite] = {
    "crmarena": Suite(clean_crm_answer, "exact_match", crm_hits, crm_coverage),
    "worfbench": Suite(clean_markdown, "rouge_l", worf_hits, worf_coverage),
}

_metrics: dict[str, PairMetric] = {}
# Python metrics give a struct: the value, and what went wrong instead of one.
_guarded: dict[str, PairMetric] = {}
OUTCOME = "value double, error string"


def register_metric(name: str, metric: PairMetric) -> None:
    """Add a metric built from column expressions: metric(prediction, reference) -> Column."""
    _guarded.pop(name, None)
    _metrics[name] = metric


def register_python_metric(name: str, scorer: Callable[[str, str], float]) -> None:
    """Add a metric given as a Python scalar function; it runs in Arrow batches.

    A text pair on which it fails scores NULL and the run goes on; `score_pairs` notes the
    failure in `metric_errors`.
    """

    def one(prediction: str | None, reference: str | None) -> tuple[float | None, str | None]:
        if prediction is None or reference is None:
            return None, None
        try:
            return float(scorer(prediction, reference)), None
        except Exception as problem:  # noqa: BLE001 - a user's metric must not end the run
            return None, type(problem).__name__

    def batch(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
        found = [one(p, r) for p, r in zip(prediction, reference)]
        return pd.DataFrame(found, columns=["value", "error"]).astype({"value": "float64", "error": "object"})

    outcome = F.pandas_udf(batch, OUTCOME)
    register_metric(name, lambda p, r: outcome(p, r)["value"])
    _guarded[name] = outcome


def unregister_metric(name: str) -> None:
    _metrics.pop(name, None)
    _guarded.pop(name, None)


def registered_metrics() -> dict[str, PairMetric]:
    return dict(_metrics)


def guarded_metrics() -> dict[str, PairMetric]:
    """The Python metrics among them, as structs of value and error."""
    return dict(_guarded)


def clean_response(benchmark: Column, response: Column) -> Column:
    """Suite-specific cleaning; other suites keep the text."""
    cleaned = F.when(F.lit(False), response)
    for name, suite in SUITES.items():
        cleaned = cleaned.when(benchmark == name, suite.clean(response))
    return cleaned.otherwise(response)


def headline_score(benchmark: Column) -> Column:
    """The score column each suite is judged by."""
    score = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, suite in SUITES.items():
        score = score.when(benchmark == name, F.col(suite.headline))
    return score

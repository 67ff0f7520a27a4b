"""All quality metrics of a table of (prediction, reference) pairs in one narrow pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import overlap
from scoreloom.functions.registry import SUITES, guarded_metrics, registered_metrics
from scoreloom.functions.rouge import common_subsequence, rouge_scores, stemmed_matches
from scoreloom.functions.text import (
    normalize_text,
    normalized_tokens,
    rouge_text,
    rouge_tokens,
    word_tokens,
)


def score_pairs(
    df: DataFrame,
    prediction: str = "response",
    reference: str = "ground_truth",
    benchmark: str = "benchmark",
    stem: bool = True,
) -> DataFrame:
    """Append every quality metric to df; suite metrics are NULL outside their suite.

    Prepared texts, then counts, then scores: what a later step mentions more than
    once is a column of the step before, so it is computed once. There is no shuffle.
    The one Python stage counts ROUGE matches; it comes first, so that no token array
    has to wait beside it. Where Python metrics are registered, `metric_errors` lists those that
    failed on a row, as 'name: exception'.
    """
    pred, ref = F.col(prediction), F.col(reference)
    low_p, low_r = F.col("_low_p"), F.col("_low_r")
    prepared = {
        "_norm_p": normalize_text(pred, low_p),
        "_norm_r": normalize_text(ref, low_r),
        "_len_p": F.array_size(word_tokens(pred, low_p)),
        "_len_r": F.array_size(word_tokens(ref, low_r)),
    }
    for name, suite in SUITES.items():
        inside = F.col(benchmark) == name
        prepared[f"_{name}_p"] = F.when(inside, suite.hits("_low_p", True))
        prepared[f"_{name}_r"] = F.when(inside, suite.hits("_low_r", True))
    tokens = {
        "_tok_p": normalized_tokens(F.col("_norm_p")),
        "_tok_r": normalized_tokens(F.col("_norm_r")),
    }
    counts = {
        "_exact": overlap.exact_match("_norm_p", "_norm_r"),
        "_sets": overlap.set_counts("_tok_p", "_tok_r"),
        "_copies": overlap.copy_counts("_tok_p", "_tok_r"),
    }
    if not stem:
        for side in "pr":
            tokens[f"_gram_{side}"] = rouge_tokens(pred if side == "p" else ref)
        for n in (1, 2):
            counts[f"_grams_{n}"] = overlap.gram_counts("_gram_p", "_gram_r", n)
    matches = stemmed_matches if stem else common_subsequence
    counted = (
        # Every other step works on the lower case: it is taken once.
        df.withColumns({"_low_p": F.lower(pred), "_low_r": F.lower(ref)})
        .withColumn("_match", matches(rouge_text(pred, low_p), rouge_text(ref, low_r)))
        .withColumns(prepared)
        .withColumns(tokens)
        .withColumns(counts)
    )
    guarded = guarded_metrics()
    if guarded:
        counted = counted.withColumns({f"_user_{name}": metric(pred, ref) for name, metric in guarded.items()})

    metrics: dict[str, Column] = {"exact_match": F.col("_exact")}
    metrics |= overlap.token_overlap("_sets")
    if stem:
        metrics |= rouge_scores("_match")
    else:
        metrics["rouge_1"] = overlap.rouge_n("_grams_1")
        metrics["rouge_2"] = overlap.rouge_n("_grams_2")
        sizes = ("_grams_1.predicted", "_grams_1.expected")
        metrics["rouge_l"] = F.expr(overlap.f_measure("_match", *sizes))
    metrics["semantic_similarity"] = overlap.semantic_similarity("_copies")
    metrics |= overlap.length_metrics("_len_p", "_len_r")
    for name, suite in SUITES.items():
        metrics |= suite.scores(f"_{name}_p", f"_{name}_r")
    metrics |= {name: metric(pred, ref) for name, metric in registered_metrics().items() if name not in guarded}
    if guarded:
        metrics |= {name: F.col(f"_user_{name}.value") for name in guarded}
        # concat is NULL without an error, and NULLs are dropped.
        failures = (F.concat(F.lit(f"{name}: "), F.col(f"_user_{name}.error")) for name in guarded)
        metrics["metric_errors"] = F.array_compact(F.array(*failures))

    kept = [c for c in df.columns if c not in metrics]
    return counted.select(*kept, *(column.alias(name) for name, column in metrics.items()))


def metric_failures(scored: DataFrame) -> DataFrame:
    """How often each Python metric failed, by kind of exception: metric, exception, failures."""
    failed = scored.select(F.explode("metric_errors").alias("failed"))
    return failed.groupBy(
        F.substring_index("failed", ": ", 1).alias("metric"), F.substring_index("failed", ": ", -1).alias("exception")
    ).agg(F.count("*").alias("failures"))

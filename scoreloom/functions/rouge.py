"""ROUGE with stemming and longest common subsequence, in Arrow batches.

Everything that built-in expressions can say stays in the plan: the text is
prepared and the F-measures are formed there. Only stems, gram counts of stems
and the LCS length come from the Python side, one pass per row and no shuffle.
"""

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.overlap import f_measure
from scoreloom.functions.porter import stem

MATCHES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("hits_1", "hits_2", "lcs", "predicted", "expected")]
)


def lcs_length(left, right):
    """Bit-parallel longest common subsequence of two token lists."""
    places = {}
    for position, token in enumerate(right):
        places[token] = places.get(token, 0) | (1 << position)
    full = (1 << len(right)) - 1
    row = full
    for token in left:
        seen = places.get(token)
        if seen is not None:
            kept = row & seen
            row = ((row + kept) | (row - kept)) & full
    return len(right) - row.bit_count()


def _shared(left, right):
    return sum((Counter(left) & Counter(right)).values())


def _match(prediction, reference):
    left = [stem(token) for token in prediction.split()]
    right = [stem(token) for token in reference.split()]
    return (
        _shared(left, right),
        _shared(zip(left, left[1:]), zip(right, right[1:])),
        lcs_length(left, right),
        len(left),
        len(right),
    )


@F.pandas_udf(MATCHES)
def stemmed_matches(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = [
        (None,) * 5 if p is None or r is None else _match(p, r)
        for p, r in zip(prediction, reference)
    ]
    return pd.DataFrame(rows, columns=MATCHES.fieldNames(), dtype="Int64")


@F.pandas_udf(T.LongType())
def common_subsequence(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if p is None or r is None else lcs_length(p.split(), r.split())
            for p, r in zip(prediction, reference)
        ],
        dtype="Int64",
    )


@F.pandas_udf(T.StringType())
def stem_tokens(text: pd.Series) -> pd.Series:
    """Stem every token of space-separated text."""
    return text.map(lambda line: None if line is None else " ".join(map(stem, line.split())))


def rouge_scores(match: str) -> dict[str, Column]:
    """ROUGE-1, ROUGE-2 and ROUGE-L F-measures from a :func:`stemmed_matches` column."""
    sizes = (f"{match}.predicted", f"{match}.expected")
    pairs = [f"greatest({size} - 1, 0)" for size in sizes]
    return {
        "rouge_1": F.expr(f_measure(f"{match}.hits_1", *sizes)),
        "rouge_2": F.expr(f_measure(f"{match}.hits_2", *pairs)),
        "rouge_l": F.expr(f_measure(f"{match}.lcs", *sizes)),
    }

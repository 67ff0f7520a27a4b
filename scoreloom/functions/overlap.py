"""Set, multiset and length comparisons of two token arrays.

The expressions are SQL over named columns: counts first, as one struct, then
scores from the fields of that struct, so that nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(top: str, bottom: str) -> str:
    """Quotient, 0 for a zero denominator, NULL when either side is NULL."""
    return (
        f"CASE WHEN {bottom} > 0 THEN ({top}) / CAST({bottom} AS DOUBLE) "
        f"WHEN ({top}) IS NOT NULL AND ({bottom}) IS NOT NULL THEN 0D END"
    )


def f_measure(hits: str, predicted: str, expected: str) -> str:
    """Harmonic mean of precision and recall, 0 without hits, NULL when a side is NULL."""
    precision = f"(CAST({hits} AS DOUBLE) / {predicted})"
    recall = f"(CAST({hits} AS DOUBLE) / {expected})"
    return (
        f"CASE WHEN {hits} > 0 THEN 2 * {precision} * {recall} / ({precision} + {recall}) "
        f"WHEN {hits} IS NOT NULL THEN 0D END"
    )


def exact_match(left: str, right: str) -> Column:
    """1.0 when two normalised texts are equal, else 0.0; NULL when either is NULL."""
    return F.expr(f"CAST({left} = {right} AS DOUBLE)")


def _repeats(tokens: str) -> str:
    """The token array in order, without the first copy of each token."""
    return f"transform(array(sort_array({tokens})), o -> filter(o, (x, i) -> x = get(o, i - 1)))[0]"


def _shared_in_order(left: str, right: str) -> str:
    """One ordered walk: copies from the left stock up, copies from the right use them up."""
    stock = "(CASE WHEN x.gram = s.gram THEN s.stock ELSE 0 END)"
    used = f"(x.side = 1 AND {stock} > 0)"
    return f"""aggregate(
      sort_array(concat(transform({left}, g -> named_struct('gram', g, 'side', 0)),
                        transform({right}, g -> named_struct('gram', g, 'side', 1)))),
      named_struct('gram', CAST(NULL AS STRING), 'stock', 0, 'hits', 0),
      (s, x) -> named_struct(
        'gram', x.gram,
        'stock', CASE WHEN x.side = 0 THEN {stock} + 1 WHEN {used} THEN {stock} - 1 ELSE 0 END,
        'hits', s.hits + CAST({used} AS INT)),
      s -> s.hits)"""


def shared_copies(left: str, right: str) -> str:
    """Size of the multiset intersection of two token arrays.

    One for every shared token, and the walk for what both sides repeat of them; most texts repeat
    little, so the walk is short, and long texts cost no more than putting them in order.
    """
    return f"array_size(array_intersect({left}, {right})) + {_shared_in_order(_repeats(left), _repeats(right))}"


def set_counts(prediction: str, reference: str) -> Column:
    """Sizes of two token sets and of what they share."""
    p, r = prediction, reference
    return F.expr(
        f"""struct(
          array_size(array_intersect({p}, {r})) AS shared,
          array_size(array_distinct({p})) AS predicted,
          array_size(array_distinct({r})) AS expected)"""
    )


def copy_counts(prediction: str, reference: str) -> Column:
    """Lengths of two token arrays and the size of their multiset intersection."""
    p, r = prediction, reference
    return F.expr(
        f"""struct(
          {shared_copies(p, r)} AS copies,
          array_size({p}) AS predicted_size,
          array_size({r}) AS expected_size)"""
    )


def token_overlap(counts: str) -> dict[str, Column]:
    """Precision, recall and F1 over token sets, from a :func:`set_counts` column."""
    shared, predicted, expected = (f"{counts}.{c}" for c in ("shared", "predicted", "expected"))
    return {
        "precision": F.expr(ratio_or_zero(shared, predicted)),
        "recall": F.expr(ratio_or_zero(shared, expected)),
        "f1": F.expr(f_measure(shared, predicted, expected)),
    }


def semantic_similarity(counts: str) -> Column:
    """Shared token copies over the geometric mean of both lengths, from a :func:`copy_counts` column."""
    weight = f"sqrt(CAST({counts}.predicted_size AS DOUBLE) * {counts}.expected_size)"
    return F.expr(ratio_or_zero(f"{counts}.copies", weight))


def _ngrams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    later = ", ".join(f"get({tokens}, i + {k})" for k in range(1, n))
    return (
        f"transform(slice({tokens}, 1, greatest(array_size({tokens}) - {n - 1}, 0)), "
        f"(x, i) -> concat_ws(' ', x, {later}))"
    )


def gram_counts(prediction: str, reference: str, n: int) -> Column:
    """Matched, predicted and expected n-grams of two token arrays.

    Both gram arrays are bound to a lambda variable, so that each is built once.
    """
    return F.expr(
        f"""transform(
          array(named_struct('l', {_ngrams(prediction, n)}, 'r', {_ngrams(reference, n)})),
          b -> named_struct('hits', {shared_copies('b.l', 'b.r')},
                            'predicted', array_size(b.l), 'expected', array_size(b.r)))[0]"""
    )


def rouge_n(counts: str) -> Column:
    """ROUGE-N F-measure from a :func:`gram_counts` column, without stemming."""
    return F.expr(f_measure(f"{counts}.hits", f"{counts}.predicted", f"{counts}.expected"))


def length_metrics(predicted: str, expected: str) -> dict[str, Column]:
    return {
        "prediction_length": F.expr(f"CAST({predicted} AS BIGINT)"),
        "reference_length": F.expr(f"CAST({expected} AS BIGINT)"),
        "length_ratio": F.expr(ratio_or_zero(predicted, expected)),
        "length_difference": F.expr(f"CAST(abs({predicted} - {expected}) AS BIGINT)"),
    }

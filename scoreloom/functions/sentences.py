"""Sentence ends with abbreviations learned from the texts themselves.

The type-based part of Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection"
(Computational Linguistics 32(4), 2006): an abbreviation and its period are a close collocation,
abbreviations are short, and they seldom stand without their period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.text import SPACES, bound, word_tokens
from scoreloom.session import settle

# The paper's threshold, and its chance that an abbreviation is written with its period.
THRESHOLD = 0.3
KEPT_PERIOD = 0.99

CLOSERS = r"[\])}>\"'»”’]*"
OPENING = r"\A[^\p{L}\p{N}]+"
CLOSING = r"[^\p{L}\p{N}.]+\z"
PERIODS = r"\.+\z"
ONE_PERIOD = r"[^.]\.\z"
SENTENCE_END = rf"[.!?]{CLOSERS}\z"
PLAIN_END = rf"(?:\A|[^.])\.{CLOSERS}\z"
# A code point reserved for use inside programs; stands for a period that ends no sentence.
GUARD = "\ufdd0"


def pieces(text: Column) -> Column:
    """What stands between white space."""
    return F.array_remove(F.split(text, SPACES), "")


def _core(piece: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(piece, OPENING, ""), CLOSING, ""))


def word_type(piece: Column) -> Column:
    """Lower-case word of a piece without outer punctuation and final periods; inner periods stay."""
    return F.regexp_replace(_core(piece), PERIODS, "")


def abbreviation_scores(texts: DataFrame, text: str = "text") -> DataFrame:
    """Every word seen before a period: type, n_period, n_plain, score.

    The score is the log-likelihood ratio of word and period as a collocation, times
    exp(-letters), inner periods + 1, and letters ** -n_plain. Words without a letter, null and
    blank texts count for nothing. One aggregate over the texts; the words are its groups.
    """
    words = (
        texts.select(F.explode(pieces(F.col(text))).alias("piece"))
        .select(word_type(F.col("piece")).alias("type"), F.rlike(_core(F.col("piece")), F.lit(ONE_PERIOD)).alias("ends"))
        .where(F.rlike("type", F.lit(r"\p{L}")))
    )
    counted = settle(
        words.groupBy("type").agg(
            F.count_if("ends").alias("n_period"), F.count_if(~F.col("ends")).alias("n_plain")
        )
    )
    # A period is a token of its own, so its share is at most a half.
    totals = counted.agg(
        (F.sum("n_period") / F.sum(F.col("n_period") * 2 + F.col("n_plain"))).alias("_share")
    )
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    ratio = 2 * (
        F.col("n_period") * (F.log(F.lit(KEPT_PERIOD)) - F.log("_share"))
        + F.col("n_plain") * (F.log(F.lit(1 - KEPT_PERIOD)) - F.log(1 - F.col("_share")))
    )
    score = ratio * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters, -F.col("n_plain"))
    candidates = counted.where("n_period > 0").crossJoin(F.broadcast(totals))
    return candidates.select("type", "n_period", "n_plain", score.alias("score"))


def learn_abbreviations(texts: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Types that are abbreviations by the texts' own evidence."""
    return abbreviation_scores(texts, text).where(F.col("score") >= threshold).select("type")


def with_abbreviations(
    df: DataFrame, keys: Sequence[str], abbreviations: DataFrame, text: str = "text", name: str = "abbreviations"
) -> DataFrame:
    """Append the abbreviations that a row's own text holds.

    `keys` name the row; rows that share them share what is found, which changes no result. The list of all
    abbreviations grows with the texts, so it is joined to the words, not handed to every task.
    """
    ending = F.filter(pieces(F.col(text)), lambda piece: F.rlike(_core(piece), F.lit(ONE_PERIOD)))
    types = F.array_distinct(F.transform(ending, word_type))
    found = (
        df.select(*keys, F.explode(types).alias("type"))
        .join(abbreviations, "type")
        .groupBy(*keys)
        .agg(F.collect_set("type").alias(name))
    )
    found = found.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), name)
    same = reduce(Column.__and__, (df[k].eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)))
    kept = F.coalesce(name, F.array().cast("array<string>"))
    return df.join(found, same, "left").select(df["*"], kept.alias(name))


def _abbreviated(piece: Column, abbreviations: Column) -> Column:
    return F.rlike(piece, F.lit(PLAIN_END)) & F.array_contains(abbreviations, word_type(piece))


def _with_pieces(text: Column, body: Callable[[Column], Column]) -> Column:
    """body(pieces), with the text split once and not once more for every piece."""
    return bound(pieces(text), body)


def sentence_count(text: Column, abbreviations: Column) -> Column:
    """Sentences of a text: . ! ? end one before white space, an abbreviation's period does not; nor need the last."""

    def counted(parts: Column) -> Column:
        last = F.size(parts) - 1
        ends = F.transform(
            parts,
            lambda piece, i: (i == last) | (F.rlike(piece, F.lit(SENTENCE_END)) & ~_abbreviated(piece, abbreviations)),
        )
        return F.size(F.filter(ends, lambda end: end))

    return _with_pieces(text, counted).cast("long")


def sentence_word_tokens(text: Column, abbreviations: Column) -> Column:
    """:func:`word_tokens` of a text whose abbreviations keep their period, unless they end the text."""

    def guarded(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.transform(
            parts,
            lambda piece, i: F.when(
                (i < last) & _abbreviated(piece, abbreviations),
                F.regexp_replace(piece, rf"\.({CLOSERS})\z", f"{GUARD}$1"),
            ).otherwise(piece),
        )

    tokens = word_tokens(F.array_join(_with_pieces(text, guarded), " "))
    return F.transform(tokens, lambda token: F.replace(token, F.lit(GUARD), F.lit(".")))

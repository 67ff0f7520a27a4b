"""Abbreviations learned from texts, and the sentence ends that follow from them."""

import math
import time

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import sentences, text

CORPUS = [
    "Dr. Hale saw the house. The house was old.",
    "Then Dr. Moss came to the house. She saw a garden, e.g. a rose.",
    "Mr. Hale and Mrs. Moss met Dr. Pratt. The garden was old.",
    "A rose is red, e.g. this rose. Mr. Pratt said: “No.” The end…",
    "Trees (oak, elm, etc.) stand in the garden. Birds, bees, etc. like the trees. Are the birds old? The birds are.",
    "The house and the garden and the rose and the trees and the birds and the bees and the end. No house is red. Are no birds red?",
]
GOLDEN = [
    ("Dr. Hale met Mr. Moss. They sat down.", 2, "Dr. Hale met Mr. Moss . They sat down ."),
    ("Plants, e.g. a rose, etc. grow. Why? They do!", 3, "Plants , e.g. a rose , etc. grow . Why ? They do !"),
    ("He asked for the Dr.", 1, "He asked for the Dr ."),
    ("Old house.\nOld garden", 2, "Old house . Old garden"),
    ("Wait... Dr.\tHale (see Mr.) left.", 2, "Wait ... Dr. Hale ( see Mr. ) left ."),
    ("", 0, ""),
    (" \n ", 0, ""),
    (None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "id INT, text STRING")


def judged(spark, rows, corpus):
    known = sentences.with_abbreviations(rows, ["id"], sentences.learn_abbreviations(corpus))
    return {
        r.id: (r.n, None if r.tokens is None else " ".join(r.tokens))
        for r in known.select(
            "id",
            sentences.sentence_count(F.col("text"), F.col("abbreviations")).alias("n"),
            sentences.sentence_word_tokens(F.col("text"), F.col("abbreviations")).alias("tokens"),
        ).collect()
    }


def test_learned_from_the_texts_alone(spark):
    scores = {r.type: r for r in sentences.abbreviation_scores(frame(spark, CORPUS)).collect()}
    learned = {t for t, r in scores.items() if r.score >= sentences.THRESHOLD}
    assert {"dr", "mr", "e.g", "etc"} <= learned
    assert not learned & {"house", "old", "garden", "rose", "trees", "end", "red", "no"}
    # By hand: three times 'Dr.', never without a period.
    share = sum(r.n_period for r in scores.values())
    plain = sum(
        1
        for line in CORPUS
        for piece in line.split()
        if not piece.rstrip(")”,:…?!").endswith(".")
    )
    share = share / (2 * share + plain)
    assert scores["dr"].n_period == 3 and scores["dr"].n_plain == 0
    assert scores["dr"].score == pytest.approx(2 * 3 * (math.log(0.99) - math.log(share)) * math.exp(-2))


def test_golden_sentences(spark):
    found = judged(spark, frame(spark, [g[0] for g in GOLDEN]), frame(spark, CORPUS))
    assert found == {i: (n, tokens) for i, (_, n, tokens) in enumerate(GOLDEN)}


def test_without_abbreviations_tokens_are_the_plain_ones(spark):
    rows = frame(spark, CORPUS)
    nothing = F.array().cast("array<string>")
    differing = rows.where(sentences.sentence_word_tokens(F.col("text"), nothing) != text.word_tokens(F.col("text")))
    assert differing.count() == 0


def test_repeated_and_null_keys_lose_no_row(spark):
    rows = spark.createDataFrame(
        [(1, "Dr. Hale left. So"), (1, "Mr. Hale left."), (None, "See Dr. Moss. Go."), (None, None), (2, "x " * 20_000 + "Dr. y")],
        "id INT, text STRING",
    )
    known = sentences.with_abbreviations(rows, ["id"], sentences.learn_abbreviations(frame(spark, CORPUS)))
    counted = known.select("id", "text", sentences.sentence_count(F.col("text"), F.col("abbreviations")).alias("n"))
    assert known.columns == ["id", "text", "abbreviations"]
    assert sorted((str(r.id), (r.text or "")[:6], r.n) for r in counted.collect()) == [
        ("1", "Dr. Ha", 2), ("1", "Mr. Ha", 1), ("2", "x x x ", 1), ("None", "", None), ("None", "See Dr", 2),
    ]


def test_empty_texts_teach_nothing(spark):
    for rows in ([], [None, "", "42. 7."]):
        assert sentences.learn_abbreviations(frame(spark, rows)).count() == 0
    assert judged(spark, frame(spark, ["Dr. Who."]), frame(spark, [])) == {0: (2, "Dr . Who .")}


def test_a_long_text_is_split_once(spark):
    # A text split again for each of its pieces takes minutes here, one split takes a moment.
    line = "Dr. Hale saw the house. " * 12_000
    rows = spark.createDataFrame([(0, line)], "id INT, text STRING").withColumn("short", F.array(F.lit("dr")))
    started = time.monotonic()
    row = rows.select(
        sentences.sentence_count(F.col("text"), F.col("short")).alias("n"),
        F.size(sentences.sentence_word_tokens(F.col("text"), F.col("short"))).alias("tokens"),
    ).first()
    assert (row.n, row.tokens) == (12_000, 6 * 12_000)
    assert time.monotonic() - started < 60

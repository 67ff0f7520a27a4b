import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import overlap, registry, rouge, text
from scoreloom.functions.porter import stem
from scoreloom.functions.quality import metric_failures, score_pairs
from scoreloom.functions.rouge import lcs_length
from scoreloom.functions.vocabulary import stemmed_by_vocabulary, vocabulary_of
from tests import brute

# Three published smoke-test pairs with scores worked out from the formulas,
# tokens split on spaces and ROUGE unstemmed.
GOLDEN = {
    "S1": (
        "crmarena",
        "I apologize for the delay. Let me check your order status and provide an update.",
        "apologize for delay, provide tracking information, offer compensation",
        (0, 0.266667, 0.5, 0.347826, 0.365148, 0.347826, 0.095238, 0.347826),
    ),
    "S2": (
        "worfbench",
        "For this architecture decision, I recommend considering scalability, maintainability, "
        "and team expertise.",
        "Consider scalability, team size, and technical complexity when choosing architecture.",
        (0, 0.333333, 0.4, 0.363636, 0.365148, 0.363636, 0.0, 0.181818),
    ),
    "T2": (
        "worfbench",
        "The system architecture should consider scalability, maintainability, and performance "
        "requirements.",
        "A well-designed system architecture must prioritize scalability, maintainability, and "
        "optimal performance.",
        (0, 0.6, 0.545455, 0.571429, 0.572078, 0.545455, 0.3, 0.545455),
    ),
}
COLUMNS = (
    "exact_match precision recall f1 semantic_similarity rouge_1 rouge_2 rouge_l"
).split()


def frame(spark, pairs, benchmark="crmarena"):
    rows = [(str(i), benchmark, p, r) for i, (p, r) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "sample_id string, benchmark string, response string, ground_truth string"
    )


def one(spark, column, value, build):
    df = spark.createDataFrame([(value,)], f"{column} string")
    return df.select(build(F.col(column)).alias("out")).first()["out"]


def test_golden_pairs(spark):
    rows = [(k, b, p, r) for k, (b, p, r, _) in GOLDEN.items()]
    df = spark.createDataFrame(rows, "sample_id string, benchmark string, response string, ground_truth string")
    for row in score_pairs(df, stem=False).collect():
        assert [round(row[c], 6) for c in COLUMNS] == pytest.approx(GOLDEN[row["sample_id"]][3])
    scored = {r["sample_id"]: r for r in score_pairs(df).collect()}
    crm = [scored["S1"][f"{c}_coverage"] for c in ("customer_service", "sales", "support", "retention")]
    assert crm == [1, 0, 0, 0] and scored["S1"]["overall_keyword_coverage"] == 0.5
    assert scored["S1"]["analytical_coverage"] is None
    assert scored["S2"]["reasoning_depth"] == 0.5 and scored["T2"]["reasoning_depth"] == 0.0
    assert scored["S2"]["sales_coverage"] is None


EDGES = [("", ""), ("word", ""), ("", "word"), ("...", "?!"), ("a a a b", "a a c"), ("Same  Text.", "same text")]


def test_edges(spark):
    scored = score_pairs(frame(spark, EDGES)).orderBy("sample_id").collect()
    assert [r["exact_match"] for r in scored] == [1, 0, 0, 1, 0, 1]
    for (p, r), row in zip(EDGES, scored):
        for name, value in (brute.overlap(p, r) | brute.rouge(p, r, True)).items():
            assert row[name] == pytest.approx(value), (p, r, name)


def test_null_in_null_out(spark):
    row = score_pairs(frame(spark, [(None, "x"), ("x", None)]).limit(1)).first()
    for name in [*COLUMNS, "prediction_length", "length_ratio", "sales_coverage"]:
        if name != "reference_length":
            assert row[name] is None, name


WORDS = "the cat sat on a mat running runner happily relational élan 42 trade-off can't well ñandú".split()


def made_up_pairs(count, longest, seed):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest)))
    return [(say(), say()) for _ in range(count)]


@pytest.mark.parametrize("stemmed", [True, False])
def test_scores_match_plain_python(spark, stemmed):
    pairs = made_up_pairs(60, 40, 1) + made_up_pairs(4, 900, 2)
    scored = {r["sample_id"]: r for r in score_pairs(frame(spark, pairs), stem=stemmed).collect()}
    for i, (p, r) in enumerate(pairs):
        row = scored[str(i)]
        for name, value in (brute.overlap(p, r) | brute.rouge(p, r, stemmed)).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (name, p, r)


def test_score_properties(spark):
    pairs = made_up_pairs(40, 30, 3)
    there = {r["sample_id"]: r for r in score_pairs(frame(spark, pairs)).collect()}
    back = {r["sample_id"]: r for r in score_pairs(frame(spark, [(b, a) for a, b in pairs])).collect()}
    for key, row in there.items():
        assert all(0 <= row[c] <= 1 + 1e-12 for c in COLUMNS)
        assert row["rouge_l"] <= row["rouge_1"] + 1e-12
        assert row["f1"] == pytest.approx(back[key]["f1"])
        assert row["semantic_similarity"] == pytest.approx(back[key]["semantic_similarity"])
    same = score_pairs(frame(spark, [("a b c a", "a b c a")])).first()
    assert all(same[c] == pytest.approx(1) for c in COLUMNS)


def test_lcs_against_table():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert lcs_length(a, b) == brute.lcs(a, b)


# Examples of the published algorithm and of its usual amendments.
STEMS = (
    "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster "
    "motoring motor conflated conflat troubled troubl hopping hop falling fall filing file "
    "happy happi sky sky relational relat conditional condit digitizer digit operator oper "
    "feudalism feudal decisiveness decis formality formal triplicate triplic electrical electr "
    "goodness good revival reviv adjustable adjust replacement replac adoption adopt "
    "effective effect probate probat cease ceas controlling control dying die news news the the"
).split()


@pytest.mark.parametrize(("word", "expected"), list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, expected):
    assert stem(word) == expected


def test_normalize_keeps_joined_words_and_other_scripts(spark):
    assert one(spark, "x", "  A trade-off, “so”\tit  is! ", text.normalize_text) == "a tradeoff “so” it is"


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [
        ("I cannot go.", "I can not go ."),
        ("Don't stop, it's 3.5, ok?", "Do n't stop , it 's 3.5 , ok ?"),
        ("Wait... (really)", "Wait ... ( really )"),
        ("At 10:30, sum 1,000", "At 10:30 , sum 1,000"),
        ("One. Two.", "One . Two ."),
        ("", ""),
    ],
)
def test_word_tokens(spark, raw, tokens):
    assert one(spark, "x", raw, text.word_tokens) == tokens.split()


def test_rouge_tokens_split_on_accents(spark):
    assert one(spark, "x", "Élan vital: 42!", text.rouge_tokens) == ["lan", "vital", "42"]


@pytest.mark.parametrize(
    ("raw", "answer"),
    [
        ("Well. Answer: Ship it\nnow...", "ship it now"),
        ("the answer is  42.", "42"),
        ("First line.\nSecond", "first line"),
        ("   ", ""),
    ],
)
def test_clean_crm_answer(spark, raw, answer):
    assert one(spark, "x", raw, text.clean_crm_answer) == answer


def test_clean_markdown(spark):
    raw = " **Bold** and *it* `code`\n\n*open\nline* "
    assert one(spark, "x", raw, text.clean_markdown) == "Bold and it code *open line*"


def test_word_count(spark):
    assert one(spark, "x", " a  b c ", text.word_count) == 3
    assert one(spark, "x", "", text.word_count) == 0


def test_shared_copies_against_counters(spark):
    pairs = made_up_pairs(30, 60, 5) + [("a " * 900 + "b", "a " * 700 + "b b"), ("", "a a"), ("a a", "b b")]
    df = frame(spark, pairs).select("sample_id", *(F.array_remove(F.split(c, " "), "").alias(c) for c in ("response", "ground_truth")))
    found = {r["sample_id"]: r["n"] for r in df.select("sample_id", F.expr(overlap.shared_copies("response", "ground_truth")).alias("n")).collect()}
    for i, (p, r) in enumerate(pairs):
        assert found[str(i)] == sum((Counter(p.split()) & Counter(r.split())).values())


# The same subsequence as built-in expressions: bit-parallel over blocks of 62 places of the right
# side, with carries from block to block.
BLOCK = 62
FULL = (1 << BLOCK) - 1
PLACES = f"""map_from_entries(transform(array_distinct(r), t -> struct(t, transform(sequence(0, (size(r) - 1) div {BLOCK}),
    b -> aggregate(slice(r, b * {BLOCK} + 1, {BLOCK}), struct(0L AS m, 1L AS bit),
                   (s, x) -> struct(s.m + IF(x = t, s.bit, 0L) AS m, shiftleft(s.bit, 1) AS bit), s -> s.m)))))"""
ADDED = "(get(rows, size(s.done)) + (get(rows, size(s.done)) & m) + s.carry)"
SUBSEQUENCE = f"""size(r) - aggregate(
    aggregate(l, transform(sequence(0, (size(r) - 1) div {BLOCK}),
                           b -> {FULL}L & (shiftleft(1L, least({BLOCK}, size(r) - b * {BLOCK})) - 1)),
      (rows, t) -> IF(NOT map_contains_key(places, t), rows, aggregate(places[t],
        struct(CAST(array() AS ARRAY<BIGINT>) AS done, 0L AS carry),
        (s, m) -> struct(concat(s.done, array(({ADDED} | (get(rows, size(s.done)) & ~m)) & {FULL}L)) AS done,
                         shiftright({ADDED}, {BLOCK}) AS carry), s -> s.done))),
    struct(0 AS n, 0 AS b), (s, row) -> struct(
      s.n + bit_count(row & (shiftleft(1L, least({BLOCK}, size(r) - s.b * {BLOCK})) - 1)) AS n, s.b + 1 AS b), s -> s.n)"""


def test_subsequence_equals_its_built_in_form(spark):
    pairs = [(p, r) for p, r in made_up_pairs(60, 40, 7) + made_up_pairs(6, 400, 8) if r]
    df = frame(spark, pairs).select("response", "ground_truth", F.split("response", " ").alias("l"), F.split("ground_truth", " ").alias("r"))
    both = df.withColumn("places", F.expr(PLACES)).select(
        F.expr(SUBSEQUENCE).alias("built_in"), rouge.common_subsequence("response", "ground_truth").alias("arrow")
    )
    assert all(r["built_in"] == r["arrow"] for r in both.collect())


TEXTS = [("a", "running cats ran"), ("a", None), (None, "Running, DOGS; the"), ("b", ""), ("b", "the the skies"), ("b", "the the skies")]


@pytest.mark.parametrize("batch", ["1", "2000"])
def test_stems_by_vocabulary(spark, batch):
    """Nulls, empty texts, repeated rows and keys, in batches with and without tokens."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(TEXTS, "k string, t string")
        found = stemmed_by_vocabulary(df, ["k"], text.rouge_tokens(F.col("t"))).collect()
        assert stemmed_by_vocabulary(df.limit(0), ["k"], text.rouge_tokens(F.col("t"))).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = [
        (k, None if t is None else [stem(w) for w in re.sub("[^a-z0-9]+", " ", t.lower()).split()]) for k, t in TEXTS
    ]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_each_token_is_stemmed_once(spark):
    """A word of every batch meets the vocabulary once per batch, and is one row of it."""
    tokens = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('w', id % 50)) AS token")
    vocabulary = vocabulary_of(tokens)
    assert vocabulary.count() == vocabulary.select("token").distinct().count() == 51


def test_registered_metrics(spark):
    registry.register_metric("both_long", lambda p, r: (F.length(p) + F.length(r)).cast("double"))
    registry.register_python_metric("first_same", lambda p, r: p[:1] == r[:1])
    try:
        row = score_pairs(frame(spark, [("abc", "ad")])).first()
        assert row["both_long"] == 5.0 and row["first_same"] == 1.0
    finally:
        registry.unregister_metric("both_long")
        registry.unregister_metric("first_same")


def test_suite_headline(spark):
    df = score_pairs(frame(spark, [("same words", "same words")], "worfbench"))
    assert df.select(registry.headline_score(F.col("benchmark")).alias("s")).first()["s"] == 1.0


def test_scoring_needs_no_shuffle_and_one_python_stage(spark):
    plan = score_pairs(frame(spark, [("a", "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_rouge_scores_as_columns(spark):
    df = frame(spark, [("running cats", "the cat runs")])
    sides = [text.rouge_text(F.col(c)) for c in ("response", "ground_truth")]
    df = df.withColumn("m", rouge.stemmed_matches(*sides))
    scores = rouge.rouge_scores("m")
    row = df.select(*(c.alias(n) for n, c in scores.items())).first()
    assert row["rouge_1"] == pytest.approx(0.8) and row["rouge_l"] == pytest.approx(0.4)


def test_a_failing_metric_scores_null_and_is_counted(spark):
    def picky(p, r):
        if p == "bad":
            raise KeyError(p)
        return None if p == "none" else 1

    registry.register_python_metric("picky", picky)
    try:
        scored = score_pairs(frame(spark, [("bad", "x"), ("good", "x"), ("none", "x"), (None, "x")])).select("response", "picky", "metric_errors", "f1").collect()
        failures = metric_failures(score_pairs(frame(spark, [("bad", "x"), ("bad", "y"), ("none", "x")]))).collect()
    finally:
        registry.unregister_metric("picky")
    found = {r["response"]: (r["picky"], r["metric_errors"]) for r in scored}
    assert found == {"bad": (None, ["picky: KeyError"]), "good": (1.0, []), "none": (None, ["picky: TypeError"]), None: (None, [])}
    assert sorted(map(tuple, failures)) == [("picky", "KeyError", 2), ("picky", "TypeError", 1)]
    assert "metric_errors" not in score_pairs(frame(spark, [("a", "b")])).columns

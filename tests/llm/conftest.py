import random

import pytest

# Extra columns that operators also name in their results.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, "
    "component_id long, ids binary, shard int, n_words long, epoch int, chunk long"
)


def make(spark, rows):
    """Documents (id, text[, lang, source]) with clashing extra columns."""
    full = [
        (i, t, *(rest or ("en", "src1")), None if t is None else len(t), 0.5, False, -1, b"x", 99, -1, 7, -5)
        for i, t, *rest in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def random_rows(seed=3, n=60):
    """Texts of few words that share passages, with copies, near copies and odd cases."""
    rnd = random.Random(seed)
    words = ["a", "der", "the", "É", "ñandú,", "x|y", "Moon", "moon", "stone.", "ring"] + [f"w{k}" for k in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [text(30) for _ in range(4)]
    rows = []
    for i in range(n):
        body = text(rnd.choice([0, 1, 2, 9, 40, 120]))
        if rnd.random() < 0.5:
            body += rnd.choice([" ", "\n", "\t"]) + rnd.choice(passages) + " " + text(5)
        rows.append((i * 3 + 1, body, rnd.choice(["en", "de", None]), rnd.choice(["src1", "src7", "web", None])))
    rows += [(500 + k, rows[k][1], "en", "src1") for k in range(10)]
    rows += [(600 + k, rows[40 + k][1] + " end", "en", "src2") for k in range(5)]
    rows += [(700, None, "en", "src1"), (701, "", "en", None), (702, " \t\n\x0b\x0c\r ", None, "src1")]
    rows += [(703, "!?" * 300 + "é" * 500 + " " * 200 + "z" * 400, "en", "src3"), (704, text(30_000), "en", "src3")]
    rows += [(705, "no breaking space\u3000and wide 中文 \U0001f600\u0301", "en", "src1")]
    rows += [(None, rows[0][1], "en", "src1"), (None, text(50), "en", "src1"), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return random_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])

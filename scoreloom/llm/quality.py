"""Quality rules: is a text closer to trusted documents or to the corpus at large?

Words and word pairs are hashed to coordinates; two multinomials count them over the trusted
documents and over all documents. A text's score is the mean log-likelihood ratio of its
n-grams under the two (so length does not matter), and one fixed threshold decides.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import GOLDEN, id_and_text, rolling, spans, word_hashes

BITS = 16
SMOOTHING = 1.0
THRESHOLD = -0.18
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

SYMBOLS = b"#*$%&|<>"
# Bytes that start no visible character: white space, and what continues a code point.
_NO_LETTER = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))


def _coded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts in order, and words per text."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    rows = [
        np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        for words in ((t or b"").split() for t in texts)
    ]
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return (word_hashes(list(codes))[flat] if len(flat) else np.empty(0, np.uint64)), lengths


def _grams(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of words and word pairs, and the text of each."""
    _, owner = spans(lengths)
    inside = owner[1:] == owner[:-1]
    pairs = ((words[:-1] * np.uint64(0x9FB21C651E98DF25)) ^ words[1:])[inside]
    at = (np.concatenate([words, pairs]) * GOLDEN) >> np.uint64(64 - BITS)
    return at.astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def _repeats(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    starts, owner = spans(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(words) < REPEAT_WINDOW:
        return out
    marks = (np.arange(len(lengths), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    hashes = rolling(words, REPEAT_WINDOW, 0x5851F42D4C957F2D)
    at = np.flatnonzero(owner[: len(hashes)] == owner[REPEAT_WINDOW - 1 :])
    keys = hashes[at] ^ marks[owner[at]]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(lengths))


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(p_trusted / p_corpus) of every coordinate, counted over all documents.

    trusted has one column of ids. Each task adds its documents into arrays of fixed size, so
    what is shuffled does not depend on the vocabulary. Without trusted documents all are 0.
    """
    marks = trusted.toDF("__trusted").where("__trusted IS NOT NULL").distinct().hint("shuffle_hash")
    joined = id_and_text(docs, id_col, text_col).join(
        marks, F.col("doc_id") == F.col("__trusted"), "left"
    ).select("text", F.col("__trusted").isNotNull().alias("good"))

    def work(batches):
        corpus, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            words, lengths = _coded(batch.column(0).to_pylist())
            at, owner = _grams(words, lengths)
            corpus += np.bincount(at, minlength=1 << BITS)
            good = np.array(batch.column(1).to_pylist(), bool)
            target += np.bincount(at[good[owner]], minlength=1 << BITS)
        used = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_pydict({"at": used, "corpus": corpus[used], "target": target[used]})

    counted = joined.mapInArrow(work, "at long, corpus long, target long")
    totals = counted.groupBy("at").agg(F.sum("corpus"), F.sum("target")).toArrow()
    corpus, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = totals.column(0).to_numpy()
    corpus[at], target[at] = totals.column(1).to_numpy(), totals.column(2).to_numpy()
    if not target.any():
        return np.zeros(1 << BITS, np.float32)
    # Smoothing adds occurrences in the corpus' own proportions, so an unseen n-gram says nothing.
    base = (corpus + SMOOTHING) / (corpus + SMOOTHING).sum()
    trusted_p = (target + SMOOTHING * base * len(base)) / (target.sum() + SMOOTHING * len(base))
    return np.log(trusted_p / base).astype(np.float32)


def judge(
    docs: DataFrame, log_ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: base counts, base_failed, score, kept.

    A null text counts as empty: no words, base_failed. A text without n-grams scores 0.
    Repeated rows are judged alike; rows without id are judged too. Only two columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios)
    fields = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"

    def work(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            words, lengths = _coded(texts)
            at, owner = _grams(words, lengths)
            n_grams = np.bincount(owner, minlength=len(lengths))
            score = np.bincount(owner, shared.value[at], minlength=len(lengths)) / np.maximum(n_grams, 1)
            repeats = _repeats(words, lengths)
            failed = (lengths < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * lengths)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_words": lengths,
                    "word_chars": [len(t.translate(None, _NO_LETTER)) for t in texts],
                    "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
                    "n_dup_lines": [_duplicate_lines(t) for t in texts],
                    "n_repeat_words": repeats,
                    "base_failed": failed,
                    "score": score,
                    "kept": ~failed & (score >= threshold),
                }
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(work, fields)

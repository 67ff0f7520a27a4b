"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, the beginnings of its words (which tie inflected forms
together), word pairs, and pairs with one word left out, each hashed to one of 2^20 coordinates.
A feature's value is its share of the text, count * SPREAD / max(n_words, SPREAD), at most CAP (so
that one word said over and over is not everything). FTRL keeps a
learning rate for each coordinate, and its L1 term leaves most weights at exactly zero, so the
model is a short list of (coordinate, weight) that is sent to every task; its size is bounded by
the number of coordinates.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import GOLDEN, give_back, id_and_text, settled, spans, word_hashes

BITS = 20
SPREAD = 64
CAP = 0.5
PREFIX = 5
EDGES = b".,;:!?\"'()[]|"
THRESHOLD = 0.7

# The model is fitted on at most this many labelled rows, those of smallest hash of their id.
MAX_LABELLED = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1.5, 0.05


def _features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of every feature occurrence, the text each belongs to, and words per text."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    rows = [
        np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        for words in ((t or b"").lower().split() for t in texts)
    ]
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    bare = [w.strip(EDGES) or w for w in codes]
    words = word_hashes(bare)[flat] if bare else np.empty(0, np.uint64)
    starts = word_hashes([w.decode("utf-8", "replace")[:PREFIX] for w in bare], 1)[flat] if bare else words
    _, owner = spans(lengths)
    shift = np.uint64(64 - BITS)
    found, owners = [words, starts], [owner, owner]
    for gap, factor in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
        inside = owner[gap:] == owner[:-gap]
        found.append(((words[:-gap] * np.uint64(factor)) ^ words[gap:])[inside])
        owners.append(owner[gap:][inside])
    at = ((np.concatenate(found) * GOLDEN) >> shift).astype(np.int64)
    return at, np.concatenate(owners), lengths


def _scale(lengths: np.ndarray) -> np.ndarray:
    return SPREAD / np.maximum(lengths, SPREAD)


def _fit(texts: list[bytes | None], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the given rows in order; coordinates seen in one text only are left out."""
    size = 1 << BITS
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    seen = np.zeros(size, np.int32)
    for first in range(0, len(texts), 256):
        at, owner, lengths = _features(texts[first : first + 256])
        order = np.argsort(owner, kind="stable")
        at = at[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(lengths)))
        for k, scale in enumerate(_scale(lengths)):
            own, count = np.unique(at[(ends[k - 1] if k else 0) : ends[k]], return_counts=True)
            seen[own] += 1
            rows.append((own.astype(np.int32), np.minimum(count * scale, CAP).astype(np.float32)))
    rows = [(own[keep], x[keep]) for own, x in rows for keep in [seen[own] > 1]]
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    for _ in range(EPOCHS):
        for (own, x), y in zip(rows, labels):
            zs, ns = z[own], n[own]
            w = np.where(
                np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
            )
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[own] += g - step * w
            n[own] += g * g
            gb = p - y
            bias_z += gb - ((bias_n + gb * gb) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += gb * gb
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept].astype(np.float32), -bias_z / ((BETA + bias_n**0.5) / ALPHA)


class ToxicityModel:
    """Sparse weights; `weights` is empty where nothing was there to learn from."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at, weights, bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        at, owner, lengths = _features(texts)
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.at] = self.weights
        known = dense[at] != 0
        found, count = np.unique(owner[known] << BITS | at[known], return_counts=True)
        owner, at = found >> BITS, found & ((1 << BITS) - 1)
        value = np.minimum(count * _scale(lengths)[owner], CAP)
        total = np.bincount(owner, dense[at] * value, minlength=len(lengths))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on labelled documents outside the held-out third (id remainder 1).

    At most `rows` labelled ids are used, those of smallest hash; a null label is none, of
    several labels of an id the largest counts. Only these ids are sent to the tasks and only
    their texts are gathered, in one task. With no label at all every score is 0.
    """
    picked = settled(
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(remainder() != 1)
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = id_and_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    bounded = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)

    def work(batches):
        seen, marks = [], []
        for batch in batches:
            seen += batch.column("text").to_pylist()
            marks += batch.column("toxic").to_pylist()
        if seen:
            at, w, bias = _fit(seen, np.array(marks, np.float64))
            yield pa.RecordBatch.from_pydict(
                {"at": [at.tobytes()], "weights": [w.tobytes()], "bias": [bias]}
            )

    ready = bounded.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    model = ready.select("text", "toxic").mapInArrow(work, "at binary, weights binary, bias double").first()
    if model is None:
        return ToxicityModel(np.empty(0, np.int32), np.empty(0, np.float32), -35.0)
    return ToxicityModel(
        np.frombuffer(model["at"], np.int32), np.frombuffer(model["weights"], np.float32), model["bias"]
    )


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row over its whole text; a null text scores as an empty one.

    A narrow pass: nothing is shuffled, rows without id are scored too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            found = [batch.column(0)]
            found.append(pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64()))
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns; null texts are scored as empty.

    Whole rows pass through the task, some hundred at a time, so none waits elsewhere for its score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                texts = part.column(part.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array(shared.value.scores(texts) < threshold))
        give_back()

    return docs.mapInArrow(work, docs.schema)

"""Hard-negative mining by angular triangle filtering.

Every vector is turned into integers and stored with its norm and its angles to a few reference
directions. By the triangle inequality the angle between an anchor and a row lies between the
largest difference and the smallest sum of their angles to any one reference; its cosine
interval, multiplied by both norms and widened for rounding, bounds their integer inner
product. Only pairs whose bounds overlap a window that is still open get integer scoring.

An anchor's positives are found first: rows of its label, the window being what beats the worst
positive so far. Each positive then opens a window of scores for negatives, whose lower end
rises with the worst negative kept so far. Anchors go to all tasks in blocks of ANCHORS, and
each block passes over all rows once for positives and once for negatives; a task returns its
best few for each anchor, so neither rows nor pairs are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import settled

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies within these percentages of the positive's.
FROM, TO = 30, 90
SCALE = 256
# Anchors sent to all tasks at once, on average.
ANCHORS = 2048
# Reference directions for each length of vectors, picked from at most this many rows of smallest hash.
REFERENCES, SAMPLE = 8, 1024
# Pairs whose bounds are computed at once.
PAIRS = 1 << 20
# Angles are known to this much: near 0 and pi the arc cosine loses half of its digits.
SLACK = 1e-7

_STORED = "row long, vec_id long, label long, is_anchor boolean, dim int, q binary, norm double, angles binary"
_FIRST = "anchor long, positive_id long, positive_score long"
_SECOND = "anchor long, slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _integers(batch: pa.RecordBatch, scale: int):
    """(positions in the batch, whole numbers) by length of vectors; vectors too large for 64-bit scores are left out."""
    column = batch.column(batch.schema.get_field_index("vector"))
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        q = np.floor(scale * flat[starts[at][:, None] + np.arange(dim)]).reshape(len(at), dim)
        with np.errstate(over="ignore"):
            fits = (q * q).sum(axis=1) < 2.0**62
        yield at[fits], q[fits]


def _angles(q: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = (q @ references.T) / norms[:, None]
    return np.arccos(np.clip(np.nan_to_num(cosine), -1, 1))


def _norms(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q * q).sum(axis=1))


def pick_references(q: np.ndarray, count: int) -> np.ndarray:
    """Unit directions far from each other, the first being the first vector that is not zero."""
    norms = _norms(q)
    unit = q[norms > 0] / norms[norms > 0][:, None]
    picked: list[np.ndarray] = []
    nearest = np.full(len(unit), -np.inf)
    while len(unit) and len(picked) < count:
        picked.append(unit[int(np.argmin(nearest)) if picked else 0])
        nearest = np.maximum(nearest, np.abs(unit @ picked[-1]))
        if nearest.min() > 1 - 1e-9:
            break
    return np.array(picked).reshape(len(picked), q.shape[1])


class Block:
    """Vectors of one length with norms and angles."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, norms: np.ndarray, angles: np.ndarray):
        self.rows, self.ids, self.labels, self.norms = rows, ids, labels, norms
        self.q, self.angles = q, angles

    def part(self, at) -> Block:
        return Block(*(x[at] for x in (self.rows, self.ids, self.labels, self.q, self.norms, self.angles)))

    def __len__(self) -> int:
        return len(self.rows)


def _blocks(table: pa.Table | pa.RecordBatch) -> dict[int, Block]:
    dims = table.column("dim").to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(dims).tolist():
        own = table.filter(pa.array(dims == dim))
        number = lambda name, own=own: own.column(name).to_numpy(zero_copy_only=False)
        raw = lambda name, kind, own=own: np.frombuffer(b"".join(own.column(name).to_pylist()), kind).reshape(len(own), -1)
        q = raw("q", np.int32) if dim else np.empty((len(own), 0), np.int32)
        angles = raw("angles", np.float64) if own.column("angles")[0].as_py() else np.empty((len(own), 0))
        out[dim] = Block(number("row"), number("vec_id"), number("label"), q, number("norm"), angles)
    return out


def bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Between what every pair's score lies: arrays of anchors times rows."""
    low, high = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for k in range(min(a.angles.shape[1], b.angles.shape[1])):
        x, y = a.angles[:, k, None], b.angles[None, :, k]
        total = x + y
        np.maximum(low, np.abs(x - y), out=low)
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    size = a.norms[:, None] * b.norms[None, :]
    safe = 1 + size * 1e-9
    return size * np.cos(np.minimum(high + SLACK, np.pi)) - safe, size * np.cos(np.maximum(low - SLACK, 0)) + safe


def _sure(low: np.ndarray, eligible: np.ndarray, count: int) -> np.ndarray:
    """What `count` eligible rows reach for certain, by anchor; whatever stays below it is not among the first `count`."""
    if low.shape[1] < count:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(eligible, low, -np.inf), -count, axis=1)[:, -count]


def scores(a: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products; floating point is exact while no sum can pass 2^53."""
    kind = np.float64 if largest < 2.0**52 else np.int64
    return (rows.astype(kind, copy=False) @ a.astype(kind, copy=False)).astype(np.int64)


def _merged(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `count` of both, higher scores first, then smaller ids."""
    score, ids = np.concatenate([best[0], score]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -score))[:count]
    return score[order], ids[order]


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _gathered(batches, at_least: int = 4096):
    """Batches joined to tables of some thousand rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= at_least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _pieces(a: Block, b: Block):
    step = max(1, PAIRS // max(1, len(a)))
    for first in range(0, len(b), step):
        piece = b.part(slice(first, first + step))
        piece.q = piece.q.astype(np.float64)
        yield piece, float(a.norms.max() * piece.norms.max())


class Positives:
    """The best rows of each anchor's own label, seen so far."""

    def __init__(self, anchors: Block, count: int):
        self.anchors, self.count = anchors, count
        self.best = [_NONE] * len(anchors)
        self.worst = np.full(len(anchors), -np.inf)
        self.scored = 0

    def add(self, rows: Block) -> None:
        for label in np.intersect1d(self.anchors.labels, rows.labels).tolist():
            own = np.flatnonzero(self.anchors.labels == label)
            a, b = self.anchors.part(own), rows.part(rows.labels == label)
            for piece, largest in _pieces(a, b):
                low, high = bounds(a, piece)
                open_ = a.rows[:, None] != piece.rows[None, :]
                open_ &= high >= np.maximum(self.worst[own], _sure(low, open_, self.count))[:, None]
                for k in np.flatnonzero(open_.any(axis=1)).tolist():
                    at = np.flatnonzero(open_[k])
                    self.scored += len(at)
                    found = scores(a.q[k], piece.q[at], largest)
                    keep = found >= self.worst[own[k]]
                    best = _merged(self.best[own[k]], found[keep], piece.ids[at][keep], self.count)
                    self.best[own[k]] = best
                    if len(best[0]) == self.count:
                        self.worst[own[k]] = np.nextafter(float(best[0][-1]), -np.inf)

    def found(self):
        for row, (score, ids) in zip(self.anchors.rows.tolist(), self.best):
            yield from ((row, i, s) for s, i in zip(score.tolist(), ids.tolist()))


class Negatives:
    """The best rows of other labels in each positive's window of scores, seen so far."""

    def __init__(self, anchors: Block, positives: dict[int, list[tuple[int, int]]], window: tuple[int, int], count: int):
        kept = [k for k, row in enumerate(anchors.rows.tolist()) if positives.get(row)]
        self.anchors, self.count = anchors.part(np.array(kept, np.int64)), count
        self.positives = [positives[row] for row in self.anchors.rows.tolist()]
        slots = max(map(len, self.positives), default=0)
        # No whole number lies in the window of a slot that is not used.
        self.least = np.full((len(kept), slots), np.inf)
        self.most = np.full((len(kept), slots), -np.inf)
        self.windows = []
        for k, own in enumerate(self.positives):
            # Whole numbers, so the ends are rounded inwards without loss.
            ends = [(-(-window[0] * p // 100), window[1] * p // 100) for _, p in own]
            self.windows.append(ends)
            for j, (least, most) in enumerate(ends):
                self.least[k, j], self.most[k, j] = least, most
        self.best = [[_NONE] * len(own) for own in self.positives]
        self.scored = 0

    def add(self, rows: Block) -> None:
        a = self.anchors
        if not len(a):
            return
        for piece, largest in _pieces(a, rows):
            low, high = bounds(a, piece)
            other = a.labels[:, None] != piece.labels[None, :]
            open_ = np.zeros(low.shape, bool)
            for least, most in zip(self.least.T, self.most.T):
                inside = other & (low >= least[:, None]) & (high <= most[:, None])
                least = np.maximum(least, _sure(low, inside, self.count))
                open_ |= (low <= most[:, None]) & (high >= least[:, None])
            open_ &= other
            for k in np.flatnonzero(open_.any(axis=1)).tolist():
                at = np.flatnonzero(open_[k])
                self.scored += len(at)
                found = scores(a.q[k], piece.q[at], largest)
                for j, (least, most) in enumerate(self.windows[k]):
                    keep = (found >= least) & (found >= self.least[k, j]) & (found <= most)
                    if keep.any():
                        best = _merged(self.best[k][j], found[keep], piece.ids[at][keep], self.count)
                        self.best[k][j] = best
                        if len(best[0]) == self.count:
                            self.least[k, j] = np.nextafter(float(best[0][-1]), -np.inf)

    def found(self):
        for k, (row, own) in enumerate(zip(self.anchors.rows.tolist(), self.anchors.ids.tolist())):
            for j, (positive, score) in enumerate(self.positives[k]):
                for s, i in zip(*(x.tolist() for x in self.best[k][j])):
                    yield row, j, own, positive, score, i, s


def _prepare(vectors: DataFrame, scale: int) -> DataFrame:
    """The rows that take part, as integers with norm and angles, each with a number of its own."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("row", F.monotonically_increasing_id())
    sample = rows.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("vector").toArrow()
    references = {}
    for batch in sample.combine_chunks().to_batches():
        for _, q in _integers(batch, scale):
            references[q.shape[1]] = pick_references(q, REFERENCES)
    shared = spark.sparkContext.broadcast(references)

    def work(batches):
        for batch in batches:
            for at, q in _integers(batch, scale):
                dim, norms = q.shape[1], _norms(q)
                angles = _angles(q, norms, shared.value.get(dim, np.empty((0, dim))))
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(own.column(own.schema.get_field_index(c)) for c in ("row", "vec_id", "label", "is_anchor")),
                        pa.array(np.full(len(at), dim), pa.int32()),
                        pa.array([x.tobytes() for x in q.astype(np.int32)], pa.binary()),
                        pa.array(norms, pa.float64()),
                        pa.array([x.tobytes() for x in angles], pa.binary()),
                    ],
                    names=["row", "vec_id", "label", "is_anchor", "dim", "q", "norm", "angles"],
                )

    return rows.mapInArrow(work, _STORED)


def _passed(rows: DataFrame, make, schema: str) -> DataFrame:
    """Every task shows its rows to fresh searches of its own, and returns what those have kept."""
    names = [field.split()[0] for field in schema.split(", ")]

    def work(batches):
        searches = make()
        for table in _gathered(batches):
            for dim, block in _blocks(table).items():
                if dim in searches:
                    searches[dim].add(block)
        found = [row for search in searches.values() for row in search.found()]
        yield pa.RecordBatch.from_pydict({name: pa.array([row[k] for row in found], pa.int32() if name == "slot" else pa.int64()) for k, name in enumerate(names)})

    return rows.mapInArrow(work, schema)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (FROM, TO),
    scale: int = SCALE,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    anchor says which rows are anchors. A component x becomes floor(scale * x), a score is the
    inner product of two rows' integers. An anchor's positives are the first rows of its label
    other than itself, by higher score, then smaller id; a positive's negatives are the first rows
    of other labels whose score is within the window, in percent of the positive's score.

    Rows without id or label, with a null vector or with a component that is null or not finite take no
    part; neither do rows whose squared norm passes 2^62, since their scores fit in no long. Rows
    of different lengths are not compared. Rows that share an id are rows of their own, each
    anchor among them too. Tables without rows or anchors give no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = ~F.exists(F.col("vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        v.alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    rows = settled(_prepare(own, scale))
    anchors = rows.where("is_anchor")
    blocks = max(1, math.ceil(anchors.count() / ANCHORS))
    results = []
    for k in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).toArrow()
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast(_blocks(block))

        def first(sent=sent):
            return {dim: Positives(a, positives) for dim, a in sent.value.items()}

        best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
        top = _passed(rows, first, _FIRST).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
        told: dict[int, list[tuple[int, int]]] = {}
        for r in top.orderBy("anchor", "place").collect():  # at most `positives` for each anchor of the block
            told.setdefault(r["anchor"], []).append((r["positive_id"], r["positive_score"]))
        known = spark.sparkContext.broadcast(told)

        def second(sent=sent, known=known):
            return {dim: Negatives(a, known.value, window, negatives) for dim, a in sent.value.items()}

        best = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
        kept = _passed(rows, second, _SECOND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
        results.append(settled(kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    if not results:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out

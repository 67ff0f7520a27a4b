"""Substring dedup: remove every word that lies in a window some earlier document also has.

Fixed-block anchors. Every document is cut into non-overlapping reference blocks of 7 words,
which are indexed; every rolling window of 7 words, of all documents, is a probe. Thirteen
words shared by two documents hold a whole reference block of either one, so each shared
passage is hit from both sides. Around the hits, all windows of 13 words are compared exactly
(by 96 bits of hash), which extends each hit to the maximal repeat.

Index and probes meet in buckets of hash values, packed: each chunk of documents sends to a
bucket its sorted distinct values, 30 bits and two flags each, and gets one bit back for each.
A passage that stands in a third of all documents is thus one value per chunk and bucket, and
no pair of documents is ever written out. Only windows next to a hit take part in the exact
comparison, where all that matters of a window is the smallest document that has it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import give_back, rolling, settled, sha256_hex, spans, word_hashes
from scoreloom.llm.packing import CHUNK, Chunk, packed, squeeze, unsqueeze

WINDOW = 13
BLOCK = 7
# Windows that go to one bucket on average; the number of buckets follows the corpus.
PER_BUCKET = 1 << 20

_ANCHOR, _FIRST, _SECOND = 0x5851F42D4C957F2D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93


def words_of(text: bytes) -> list[bytes]:
    return text.split()


class _Windows:
    """The hashes of a chunk."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.starts, self.owner = spans(chunk.lengths)
        hashes = word_hashes(chunk.pieces())
        self.words = hashes[chunk.codes] if len(chunk.codes) else np.empty(0, np.uint64)
        self.named = ~chunk.no_id

    def at(self, width: int) -> np.ndarray:
        """Positions where a window of this width fits in its document (one that has an id)."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        fits = self.owner[:n] == self.owner[width - 1 :]
        return np.flatnonzero(fits & self.named[self.owner[:n]])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all probes in hash order, where a new value begins, the values, and their flags."""
        at = self.at(BLOCK)
        hashes = rolling(self.words, BLOCK, _ANCHOR)[at]
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(at) else np.empty(0, np.int64)
        if not len(first):
            return at, first, hashes, np.empty(0, np.uint32)
        owner = self.owner[at]
        ids = self.chunk.ids[owner]
        index = np.maximum.reduceat(((at - self.starts[owner]) % BLOCK == 0).astype(np.uint32), first)
        several = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)).astype(np.uint32)
        return at, first, hashes[first], index | several << 1

    def candidates(self, hit: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain a hit anchor."""
        marked = np.zeros(len(self.words) + WINDOW, np.int64)
        where = at[np.repeat(hit, np.diff(np.append(first, len(at))))]
        reach = WINDOW - BLOCK
        np.add.at(marked, np.maximum(where - reach, 0), 1)
        np.add.at(marked, where + 1, -1)
        near = np.cumsum(marked) > 0
        fits = self.at(WINDOW)
        return fits[near[fits]]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidate starts in order of their exact key and document, where a key begins, the keys."""
        one = rolling(self.words, WINDOW, _FIRST)[at]
        two = (rolling(self.words, WINDOW, _SECOND)[at] >> np.uint64(32)).astype(np.uint32)
        ids = self.chunk.ids[self.owner[at]]
        order = np.lexsort((ids, two, one))
        at, one, two = at[order], one[order], two[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        return at, first, one[first], two[first]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _parts(hashes: np.ndarray, buckets: int):
    """(bucket, slice) of sorted hashes, only buckets that have some."""
    bounds = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), slice(bounds[b], bounds[b + 1])


def _rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _send_anchors(buckets: int):
    def work(batches):
        for row in _rows_of(batches):
            _, _, values, flags = _Windows(Chunk(row)).anchors()
            low = (values.astype(np.uint32) << np.uint32(2)) | flags
            out: dict[str, list] = {"bucket": [], "chunk": [], "values": []}
            for b, part in _parts(values, buckets):
                out["bucket"].append(b)
                out["chunk"].append(row["chunk"])
                out["values"].append(low[part].tobytes())
            yield pa.RecordBatch.from_pydict(
                out, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("values", pa.binary())])
            )

    return work


def _find_hits(group: pd.DataFrame) -> pd.DataFrame:
    """Which values of each chunk stand in two documents, as a reference block in one at least."""
    sent = [np.frombuffer(v, np.uint32) for v in group["values"]]
    flat = np.concatenate(sent)
    kept, inverse, count = np.unique(flat >> np.uint32(2), return_inverse=True, return_counts=True)
    index, several = np.zeros(len(kept), bool), count > 1
    index[inverse[(flat & 1) > 0]] = True
    several[inverse[(flat & 2) > 0]] = True
    hit = (index & several)[inverse]
    ends = np.cumsum([len(v) for v in sent])
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
    return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "hits": bits})


def _hits(answers: pd.DataFrame, column: str, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of all buckets put back in the order of a chunk's values."""
    told = dict(zip(answers["bucket"], answers[column]))
    out = np.zeros(len(hashes), bool)
    for b, part in _parts(hashes, buckets):
        bits = np.frombuffer(told[b], np.uint8)
        out[part] = np.unpackbits(bits, count=part.stop - part.start).astype(bool)
    return out


def _opened(chunk: pd.DataFrame, hits: pd.DataFrame, buckets: int):
    windows = _Windows(Chunk(chunk.iloc[0].to_dict()))
    at, first, values, _ = windows.anchors()
    near = windows.candidates(_hits(hits, "hits", values, buckets), at, first)
    return windows, windows.keys(near)


def _send_windows(buckets: int):
    def work(chunk: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"bucket": [], "chunk": [], "one": [], "two": [], "least": []}
        if len(chunk):
            windows, (at, first, one, two) = _opened(chunk, hits, buckets)
            least = windows.chunk.ids[windows.owner[at[first]]]
            for b, part in _parts(one, buckets):
                out["bucket"].append(b)
                out["chunk"].append(int(chunk["chunk"].iloc[0]))
                out["one"].append(one[part].tobytes())
                out["two"].append(two[part].tobytes())
                out["least"].append(squeeze(least[part]))
            del windows, at, first, one, two, least
        give_back()
        return pd.DataFrame(out)

    return work


def _find_later(group: pd.DataFrame) -> pd.DataFrame:
    """Which keys of each chunk stand in a document before all of the chunk's own."""
    one = np.concatenate([np.frombuffer(v, np.uint64) for v in group["one"]])
    two = np.concatenate([np.frombuffer(v, np.uint32) for v in group["two"]])
    pieces = [unsqueeze(v, np.int64) for v in group["least"]]
    least = np.concatenate(pieces)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = np.flatnonzero(new)
    lowest = np.minimum.reduceat(least[order], first)
    later = np.empty(len(order), bool)
    later[order] = least[order] > np.repeat(lowest, np.diff(np.append(first, len(order))))
    ends = np.cumsum([len(v) for v in pieces])
    bits = [np.packbits(later[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
    return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "later": bits})


def _finish(buckets: int):
    def work(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "kept_sha256": [], "mark": []}
        if len(chunk):
            hits = answers[answers["hits"].notna()]
            windows, (at, first, one, two) = _opened(chunk, hits, buckets)
            later = _hits(answers[answers["later"].notna()], "later", one, buckets)
            runs = np.diff(np.append(first, len(at)))
            ids = windows.chunk.ids[windows.owner[at]]
            lost = np.repeat(later, runs) | (ids > np.repeat(ids[first], runs))
            cover = np.zeros(len(windows.words) + WINDOW + 1, np.int64)
            np.add.at(cover, at[lost], 1)
            np.add.at(cover, at[lost] + WINDOW, -1)
            kept = np.cumsum(cover)[: len(windows.words)] == 0
            pieces = np.array(windows.chunk.pieces(), object)
            ends = np.cumsum(windows.chunk.lengths)
            own = windows.chunk
            for doc_id, no_id, mark, a, b in zip(own.ids, own.no_id, own.marks, ends - own.lengths, ends):
                stay = kept[a:b]
                left = b" ".join(pieces[windows.chunk.codes[a:b][stay]])
                gone = int(len(stay) - stay.sum())
                out["doc_id"].append(None if no_id else int(doc_id))
                out["n_words"].append(int(b - a))
                out["n_removed"].append(gone)
                out["kept"].append(left if gone else None)
                out["kept_sha256"].append(sha256_hex(left))
                out["mark"].append(int(mark))
            del windows, own, at, first, one, two, cover, kept, pieces
        give_back()
        frame = pd.DataFrame(out)
        return frame.astype({"doc_id": "Int64"})

    return work


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept, kept_sha256, mark (the text's xxhash64).

    A word goes if it is covered by 13 consecutive words that also start in a document with a
    smaller id; windows are judged on the input. `kept` is what is left, words joined by one
    space, as bytes, and null where nothing was removed. Null and empty texts have no words; a
    row without id neither loses words nor takes any from others; rows with equal ids do not
    remove each other's words. Smaller chunks need less memory and move a little more.
    """
    chunks = packed(docs, words_of, id_col, text_col, chunk, marked=True)
    total = chunks.agg(F.sum("n_pieces")).first()[0] or 0
    buckets = max(1, -(-total // PER_BUCKET))
    sent = chunks.mapInArrow(_send_anchors(buckets), "bucket long, chunk long, values binary")
    hits = sent.groupBy("bucket").applyInPandas(_find_hits, "bucket long, chunk long, hits binary")
    hits = settled(hits)
    windows = (
        chunks.groupBy("chunk")
        .cogroup(hits.groupBy("chunk"))
        .applyInPandas(_send_windows(buckets), "bucket long, chunk long, one binary, two binary, least binary")
    )
    later = windows.groupBy("bucket").applyInPandas(_find_later, "bucket long, chunk long, later binary")
    answers = hits.withColumn("later", F.lit(None).cast("binary")).unionByName(
        later.withColumn("hits", F.lit(None).cast("binary"))
    )
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(
            _finish(buckets), "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string, mark long"
        )
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """All documents with their columns, the text of those that lost words being the words left.

    A document of which nothing is left stays with an empty text; other texts are not touched.
    A column n_chars follows the new text. Rows are told apart by id and text.
    """
    changed = (
        find_repeats(docs, id_col, text_col, chunk)
        .where("n_removed > 0 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("kept").cast("string").alias("__left"))
        .dropDuplicates(["__id", "__mark"])
    )
    same = (docs[id_col].cast("long") == F.col("__id")) & (F.xxhash64(docs[text_col].cast("binary")) == F.col("__mark"))
    joined = docs.join(changed, same, "left")
    gone, left = F.col("__id").isNotNull(), F.col("__left")
    new = {text_col: F.when(gone, left).otherwise(docs[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone, F.length(left).cast("long")).otherwise(docs["n_chars"])
    return joined.select(*(new.get(c, docs[c]).alias(c) for c in docs.columns))

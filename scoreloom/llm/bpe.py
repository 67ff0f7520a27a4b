"""Byte-level BPE by a table of ranks: encoding and decoding of whole texts.

Texts are split into pre-tokens by a pattern and packed into chunks, where every position holds
the number of its pre-token. The distinct pre-tokens of all chunks meet in a shuffle by hash,
each distinct one is encoded once, its ids go back to the chunks that have it, and positions
are filled in. What moves is each chunk's dictionary, not its occurrences, so a word that is a
third of all text is one entry per chunk.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import give_back, word_hashes
from scoreloom.llm.packing import CHUNK, Chunk, packed, squeeze, unsqueeze

# Distinct pre-tokens of chunks that meet in one bucket, on average.
PER_BUCKET = 1 << 18
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is joined, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG:
        return _merge_long(piece, ranks)
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for pieces where trying all pairs would be quadratic."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < n:
            stop = end[end[at]]
            rank = ranks.get(piece[at:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, at, stop))

    for at in range(n - 1):
        offer(at)
    while heap:
        _, at, stop = heapq.heappop(heap)
        if not alive[at] or end[at] >= n or end[end[at]] != stop:
            continue
        alive[end[at]] = False
        end[at] = stop
        if stop < n:
            before[stop] = at
        offer(before[at])
        offer(at)
    return [ranks[piece[at : end[at]]] for at in range(n) if alive[at]]


def _order(pieces: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pieces grouped by bucket, and where each bucket begins in them."""
    of = (word_hashes(pieces) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _send(buckets: int):
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pieces = Chunk(row).pieces()
                order, bounds = _order(pieces, buckets)
                out: dict[str, list] = {"bucket": [], "chunk": [], "lengths": [], "pieces": []}
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = [pieces[k] for k in order[bounds[b] : bounds[b + 1]]]
                    out["bucket"].append(b)
                    out["chunk"].append(row["chunk"])
                    out["lengths"].append(squeeze(np.fromiter(map(len, mine), np.uint32, len(mine))))
                    out["pieces"].append(squeeze(np.frombuffer(b"".join(mine), np.uint8)))
                yield pa.RecordBatch.from_pydict(
                    out,
                    pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("lengths", pa.binary()), ("pieces", pa.binary())]),
                )

    return work


def _encode(ranks):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, list[int]] = {}
        out: dict[str, list] = {"bucket": group["bucket"], "chunk": group["chunk"], "counts": [], "ids": []}
        for lengths, pieces in zip(group["lengths"], group["pieces"]):
            joined = unsqueeze(pieces, np.uint8).tobytes()
            ends = np.cumsum(unsqueeze(lengths, np.uint32), dtype=np.int64).tolist()
            counts, ids = [], []
            for a, b in zip([0, *ends], ends):
                piece = joined[a:b]
                found = known.get(piece)
                if found is None:
                    found = known[piece] = merge(piece, ranks.value)
                counts.append(len(found))
                ids += found
            out["counts"].append(squeeze(np.array(counts, np.uint32)))
            out["ids"].append(squeeze(np.array(ids, np.uint32)))
        return pd.DataFrame(out)

    return work


def _assemble(buckets: int):
    def work(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "ids": pd.Series(dtype=object)})
        opened = Chunk(chunk.iloc[0].to_dict())
        order, _ = _order(opened.pieces(), buckets)
        told = told.sort_values("bucket")
        counts, ids = np.zeros(len(order), np.int64), np.empty(0, np.uint32)
        if len(told):
            counts[order] = np.concatenate([unsqueeze(c, np.uint32) for c in told["counts"]])
            ids = np.concatenate([unsqueeze(i, np.uint32) for i in told["ids"]])
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        rows, at = [], 0
        for n in opened.lengths.tolist():
            codes = opened.codes[at : at + n]
            at += n
            many = counts[codes]
            shift = first[codes] - (np.cumsum(many) - many)
            rows.append(ids[np.repeat(shift, many) + np.arange(many.sum())].astype("<u4").tobytes())
        doc_ids = pd.array(opened.ids, "Int64")
        doc_ids[opened.no_id] = pd.NA
        del opened, ids, counts, first, told
        give_back()
        return pd.DataFrame({"doc_id": doc_ids, "ids": rows})

    return work


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text as little-endian 32-bit numbers.

    Each match of the pattern is encoded by itself; no special tokens. A null text counts as
    empty and has no ids. Rows without id and repeated rows are encoded like any other. The
    ranks, whose size is the vocabulary's, are sent to every task. Smaller chunks need less memory
    and move a little more.
    """
    find = regex.compile(pattern).findall

    def split(text: bytes) -> list[str]:
        return find(text.decode("utf-8", "replace"))

    chunks = packed(docs, split, id_col, text_col, chunk)
    total = chunks.agg(F.sum("n_distinct")).first()[0] or 0
    buckets = max(1, -(-total // PER_BUCKET))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    told = (
        chunks.mapInArrow(_send(buckets), "bucket long, chunk long, lengths binary, pieces binary")
        .groupBy("bucket")
        .applyInPandas(_encode(shared), "bucket long, chunk long, counts binary, ids binary")
    )
    return (
        chunks.groupBy("chunk")
        .cogroup(told.groupBy("chunk"))
        .applyInPandas(_assemble(buckets), "doc_id long, ids binary")
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, decoded) with the bytes of the ids' tokens in order.

    A join with the table of token bytes, which every task holds whole: it has one row per token
    of the vocabulary. An id that is not in the table fails.
    """
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def work(batches):
        for batch in batches:
            token = shared.value.__getitem__
            texts = [b"".join(map(token, np.frombuffer(i, "<u4").tolist())) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, decoded binary")

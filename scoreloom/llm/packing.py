"""Documents packed into chunks: the pieces of their texts as numbers of a dictionary each chunk has.

A chunk is a row that holds some documents whole: their ids, how many pieces each has, the
distinct pieces, and for every position the piece's number. Work on distinct pieces is then a
small table, and results return to positions by the number. Chunks are bounded by `CHUNK`
bytes of text (a longer document is a chunk of its own).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import give_back, id_and_text, stored

CHUNK = 8 << 20
COLUMNS = "chunk long, ids binary, no_id binary, lengths binary, piece_lengths binary, pieces binary, codes binary, n_pieces long, n_distinct long"
MARKS = ", marks binary"


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Chunk:
    """A packed row, opened."""

    def __init__(self, row: dict):
        self.row = row
        self.ids = unsqueeze(row["ids"], np.int64)
        self.no_id = unsqueeze(row["no_id"], np.bool_)
        self.lengths = unsqueeze(row["lengths"], np.int64)
        self.codes = unsqueeze(row["codes"], np.uint32)
        self.marks = unsqueeze(row["marks"], np.int64) if "marks" in row else None

    def pieces(self) -> list[bytes]:
        """The distinct pieces by number."""
        joined = zstandard.ZstdDecompressor().decompress(self.row["pieces"])
        ends = np.cumsum(unsqueeze(self.row["piece_lengths"], np.uint32), dtype=np.int64).tolist()
        return [joined[a:b] for a, b in zip([0, *ends], ends)]


def _closed(number: int, ids: list, lengths: list, codes: list, distinct: dict, marks: list | None = None) -> pa.RecordBatch:
    pieces = [p.encode() if isinstance(p, str) else p for p in distinct]
    row = {
        "chunk": number,
        "ids": squeeze(np.array([0 if i is None else i for i in ids], np.int64)),
        "no_id": squeeze(np.array([i is None for i in ids], np.bool_)),
        "lengths": squeeze(np.array(lengths, np.int64)),
        "piece_lengths": squeeze(np.fromiter(map(len, pieces), np.uint32, len(pieces))),
        "pieces": zstandard.ZstdCompressor(level=3).compress(b"".join(pieces)),
        "codes": squeeze(np.concatenate(codes)),
        "n_pieces": sum(lengths),
        "n_distinct": len(pieces),
    }
    if marks is not None:
        row["marks"] = squeeze(np.array(marks, np.int64))
    return pa.RecordBatch.from_pydict({name: [value] for name, value in row.items()})


def packed(
    docs: DataFrame,
    split: Callable[[bytes], list],
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = CHUNK,
    marked: bool = False,
) -> DataFrame:
    """Chunks of all documents, stored bucketed by chunk so that joins do not move them.

    split makes a text's pieces, bytes or strings; a null text has none. Marked chunks also hold
    each text's xxhash64, which tells rows with equal ids apart.
    """

    def work(batches):
        number = TaskContext.get().partitionId() << 32

        def fresh():
            distinct: defaultdict[bytes, int] = defaultdict()
            distinct.default_factory = distinct.__len__
            return [], [], [], distinct, [] if marked else None, 0

        ids, lengths, codes, distinct, marks, held = fresh()
        for batch in batches:
            if marked:
                own = iter(batch.column(2).to_pylist())
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                pieces = split(text)
                ids.append(doc_id)
                lengths.append(len(pieces))
                codes.append(np.fromiter(map(distinct.__getitem__, pieces), np.uint32, len(pieces)))
                if marked:
                    marks.append(next(own))
                held += len(text)
                if held >= size:
                    yield _closed(number, ids, lengths, codes, distinct, marks)
                    number += 1
                    ids, lengths, codes, distinct, marks, held = fresh()
        if ids:
            yield _closed(number, ids, lengths, codes, distinct, marks)
        del ids, lengths, codes, distinct, marks
        give_back()

    rows, columns = id_and_text(docs, id_col, text_col), COLUMNS
    if marked:
        rows, columns = rows.withColumn("mark", F.xxhash64("text")), COLUMNS + MARKS
    return docs.sparkSession.table(stored(rows.mapInArrow(work, columns), "chunk"))

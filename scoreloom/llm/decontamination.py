"""Benchmark decontamination: every window of a text is looked up in a hash set of the benchmark's n-grams.

Words are runs of letters and digits, A-Z lower-cased; everything outside ASCII counts as a
letter. A window is 10 consecutive words of a benchmark item, or the whole item where it has
fewer. The windows of the items are sent to every task as sorted 64-bit hashes together with
the windows themselves; a text's rolling hashes are looked up, and each hit is verified word by
word. That is a narrow pass over the texts: nothing of them is shuffled.

What is sent holds BLOCK_BYTES of normalised benchmark text at a time, whatever the benchmark's
size: a larger one goes in several blocks, one pass over the texts for each, and a pass adds to
what the passes before it have found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from scoreloom.llm.common import id_and_text, rolling, settled, spans, word_hashes

WINDOW = 10
BLOCK_BYTES = 4 << 20
# Words of an item that stay together; longer items are cut, with WINDOW - 1 words in common.
SEGMENT = 4096

_MULTIPLIER = 0x5851F42D4C957F2D
# A first look at this many bits of a hash passes few windows on to the search.
_LOOK = np.uint64(20)

# Byte by byte: a-z, 0-9 and all beyond ASCII stay, A-Z are lowered, the rest is a gap.
_PLAIN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_FOUND = StructType(
    [
        StructField("__n_words", LongType()),
        StructField("__hits", ArrayType(LongType())),
        StructField("__items", ArrayType(LongType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


class Grams:
    """The windows of some benchmark segments: sorted hashes by width, and the items of each window."""

    def __init__(self, segments: list[tuple[int | None, str]], width: int):
        items: defaultdict[bytes, set] = defaultdict(set)
        hashes: defaultdict[int, list] = defaultdict(list)
        for item, joined in segments:
            words = joined.encode().split()
            w = min(width, len(words))
            for k in range(len(words) - w + 1):
                items[b" ".join(words[k : k + w])].add(item)
            hashes[w].append(rolling(word_hashes(words), w, _MULTIPLIER))
        self.items = {gram: tuple(own) for gram, own in items.items()}
        self.hashes = {w: np.unique(np.concatenate(found)) for w, found in hashes.items()}

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(width, starts) of the windows inside one text whose hash is in the set."""
        for w, known in self.hashes.items():
            windows = rolling(hashes, w, _MULTIPLIER)
            look = np.zeros(1 << int(_LOOK), bool)
            look[known >> (np.uint64(64) - _LOOK)] = True
            at = np.flatnonzero(look[windows >> (np.uint64(64) - _LOOK)])
            place = np.minimum(np.searchsorted(known, windows[at]), len(known) - 1)
            at = at[known[place] == windows[at]]
            yield w, at[owner[at] == owner[at + w - 1]]


def _segments(width: int):
    def work(batches):
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if words:
                    for k in range(0, max(1, len(words) - width + 1), SEGMENT - width + 1):
                        items.append(item)
                        pieces.append(b" ".join(words[k : k + SEGMENT]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(pieces, pa.string())], names=["item_id", "words"])

    return work


def _scan(grams: Grams, texts: list[bytes | None], hits: list, items: list) -> tuple[list, list, list]:
    """Words per text, and covered word spans (start, end, start, end, ...) and item ids with those found before."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    rows = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
    lengths = np.array([len(r) for r in rows], np.int64)
    codes = np.concatenate(rows) if rows else np.empty(0, np.int64)
    starts, owner = spans(lengths)
    pieces = list(number)
    hashes = word_hashes(pieces)[codes] if pieces else np.empty(0, np.uint64)
    cover = np.zeros(len(codes) + 1, np.int64)
    found: defaultdict[int, set] = defaultdict(set)
    for w, at in grams.hits(hashes, owner):
        for k in at.tolist():
            own = grams.items.get(b" ".join([pieces[c] for c in codes[k : k + w].tolist()]))
            if own is not None:
                cover[k] += 1
                cover[k + w] -= 1
                found[int(owner[k])].update(own)
    if hits:
        for d in (d for d, old in enumerate(hits) if old):
            old = starts[d] + np.array(hits[d], np.int64)
            np.add.at(cover, old[0::2], 1)
            np.add.at(cover, old[1::2], -1)
            found[d].update(items[d])
    hit = np.cumsum(cover[:-1]) > 0
    spans_of, items_of = [], []
    for d, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        if d in found:
            turns = np.flatnonzero(np.diff(np.concatenate([[0], hit[a : a + n].view(np.int8), [0]])))
            spans_of.append(turns.tolist())
            items_of.append(list(found[d]))
        else:
            spans_of.append([])
            items_of.append([])
    return lengths.tolist(), spans_of, items_of


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text: str, text_col: str) -> DataFrame:
    """All columns of docs, and what was found: words, spans of hit words, ids of the items hit (null if they have none)."""
    spark = docs.sparkSession
    pieces = settled(
        id_and_text(benchmark, item_col, item_text).mapInArrow(_segments(width), "item_id long, words string").distinct()
    )
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    schema = StructType(docs.schema.fields + _FOUND.fields)
    for block in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Grams([tuple(r) for r in own], width))
        again = block > 0

        def work(batches, shared=shared, again=again):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                before = [batch.column(k).to_pylist() for k in (-2, -1)] if again else [[], []]
                found = _scan(shared.value, texts, *before)
                kept = batch.columns[:-3] if again else batch.columns
                names = batch.schema.names[: len(kept)] + _FOUND.names
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(kept + [pa.array(x, k) for x, k in zip(found, kinds)], names=names)

        docs = docs.mapInArrow(work, schema)
        if block < blocks - 1:
            docs = settled(docs)
    return docs


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), hits.

    hits are the word positions start, end, start, end, ... of maximal runs of hit words. Null
    and empty texts have no words; an item without words marks nothing; an item without id
    marks words but is not counted. Items may be repeated or share an id. Repeated rows are
    judged alike, rows without id are judged too. Without benchmark rows nothing is hit. Other
    columns are not read.
    """
    found = _searched(id_and_text(docs, id_col, text_col), benchmark, width, item_col, item_text, "text")
    ends = F.expr("filter(__hits, (x, i) -> i % 2 = 1)")
    begins = F.expr("filter(__hits, (x, i) -> i % 2 = 0)")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.array_sort(F.transform(F.array_compact("__items"), lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        (total(ends) - total(begins)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.col("__hits").alias("hits"),
    )


def _cut(text: bytes, hits: list[int]) -> bytes:
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_PLAIN))]
    out, at = [], 0
    for a, b in zip(hits[0::2], hits[1::2]):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def _changed(found: DataFrame, like: DataFrame, work: Callable) -> DataFrame:
    return found.mapInArrow(work, like.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text", **columns) -> DataFrame:
    """The documents without any hit word, all columns as they were."""
    found = _searched(docs, benchmark, width, columns.get("item_col", "item_id"), columns.get("item_text", "text"), text_col)
    return found.where(F.size("__hits") == 0).drop(*_FOUND.names)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text", **columns) -> DataFrame:
    """All documents, with the hit words and what stands between them cut from the texts; other columns stay."""
    found = _searched(docs, benchmark, width, columns.get("item_col", "item_id"), columns.get("item_text", "text"), text_col)

    def work(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts, hits = batch.column(k).cast(pa.binary()).to_pylist(), batch.column(-2).to_pylist()
            cut = [_cut(t, h) if h else t for t, h in zip(texts, hits)]
            kept = list(batch.columns[:-3])
            kept[k] = pa.array(cut, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names[:-3])

    return _changed(found, docs, work)

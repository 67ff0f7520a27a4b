"""Token ids of documents as raw binary blocks, with a minimal perfect hash index over the keys.

The store is two tables in the shared folder.

* blocks: ids of consecutive documents, in ascending order of document id, as raw
  little-endian numbers of 2 bytes (4 for vocabularies beyond 65,536), about `BLOCK` bytes to a
  block, with the directory of the block's documents beside it.
* index: the keys in buckets of about `KEYS` keys. A bucket's hash function is a cascade of bit
  arrays: a key belongs to the first level where no other key shares its bit, and its slot is
  the number of bits set before it. By slot lie a 32-bit fingerprint of the key, the block, the
  place in the block, the length, and the number of ids in all documents before it. A lookup
  reads one bucket and one block, whatever the size of the store.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import GOLDEN, give_back, id_and_text, mixed, stored
from scoreloom.operators.numbering import number_rows

BLOCK = 8 << 20
# Bytes of text that one part, a range of consecutive rows, should hold at most.
PART = 256 << 20
KEYS = 1 << 16
GAMMA = 2.0
LEVELS = 32
# Words that a worker remembers the ids of.
MEMO = 600_000
# Marks: a run of them after letters is a pre-token of its own.
TAIL = string.punctuation
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
# Letters of Latin-1 once A-Z are small: none of them combines with another.
LETTERS = "^[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"


class _Encoder:
    """Ids of texts by a tokenizer whose tokens never span white space; words are remembered."""

    def __init__(self, json: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.kind = "H" if width == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        # The model's spelling of letters beyond ASCII: one visible character for each of their bytes.
        signs = list(map(chr, range(256)))
        for letter in map(chr, range(0xDF, 0x100)):
            if PLAIN(letter):
                for byte, sign in zip(letter.encode(), self.tokenizer.pre_tokenizer.pre_tokenize_str(letter)[0][0]):
                    signs[byte] = sign
        self.signs = "".join(signs)
        # Words met since the memo was last half full, and those of the half before.
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _tails(self, marks: list[bytes]) -> list[bytes]:
        if len(self.tails) > MEMO:
            self.tails.clear()
        for new in set(marks).difference(self.tails):
            self.tails[new] = self._bytes(self.tokenizer.encode(new.decode(), add_special_tokens=False).ids)
        return list(map(self.tails.__getitem__, marks))

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words."""
        rest = []
        for word in words:
            text = word.decode("utf-8", "replace")
            spelled = text.lower()
            # Small Latin letters are one pre-token that no normaliser changes.
            if not (spelled.isascii() and spelled.isalpha()):
                if not PLAIN(spelled):
                    rest.append((word, text))
                    continue
                spelled, _ = charmap_decode(spelled.encode(), "strict", self.signs)
            self.words[word] = self._bytes([token.id for token in self.tokenize(spelled)])
        texts = [text for _, text in rest]
        for (word, _), found in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self.words[word] = self._bytes(found.ids)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.words) > MEMO // 2:
            # Words met in neither half go.
            self.older, self.words = self.words, {}
        new = []
        for word in filterfalse(self.words.__contains__, words):
            ids = self.older.get(word)
            if ids is None:
                new.append(word)
            else:
                self.words[word] = ids
        self._learn(new)
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        rows = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).fill_null(b"").view(pa.string()))
        words = rows.values.dictionary_encode()
        word = words.dictionary
        # A word of Latin letters with marks after it has the ids of its small form, then those of the marks.
        core = pc.ascii_rtrim(pc.ascii_lower(word), TAIL)
        plain = pc.match_substring_regex(core, LETTERS)
        forms = pc.if_else(plain, core, word).dictionary_encode()
        ids = pa.array(self._ids(_binary(forms.dictionary)), pa.binary()).take(forms.indices)
        marks = pc.subtract(pc.binary_length(word), pc.binary_length(core))
        marked = pc.and_(plain, pc.greater(marks, 0))
        tails = self._tails([w[-k:] for w, k in zip(_binary(word.filter(marked)), marks.filter(marked).to_pylist())])
        joined = pc.binary_join_element_wise(ids.filter(marked), pa.array(tails, pa.binary()), b"")
        ids = pc.replace_with_mask(ids, marked, joined).take(words.indices)
        # Texts lie one after the other in the bytes of their words.
        ends = np.frombuffer(ids.buffers()[1], np.int32)[rows.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), ids.buffers()[2]]).to_pylist()


def _binary(words: pa.Array) -> list[bytes]:
    return words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


_encoders: dict[int, _Encoder] = {}


def _encoder(json: str, width: int) -> _Encoder:
    """One encoder for each tokenizer and worker process."""
    key = hash((json, width))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(json, width)
    return _encoders[key]


def _keys(ids: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """One 64-bit number for an id and which of its rows is meant (negative: rows without id)."""
    return mixed(ids.view(np.uint64), 1) ^ (turns.astype(np.int64).view(np.uint64) * GOLDEN)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys, 2) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash function of distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits) - bits

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, left, level = [], [], keys, 0
        while len(left):
            if level == LEVELS:
                raise ValueError("two documents have the same 64-bit key")
            size = max(64, int(GAMMA * len(left)))
            at = (mixed(left, 16 + level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            left, level = left[~alone[at]], level + 1
        bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), bits.astype(np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for a key that certainly was not there."""
        out = np.full(len(keys), -1, np.int64)
        start, left = 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = start + (mixed(keys[left], 16 + level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        return out


@dataclass(frozen=True)
class TokenStore:
    """Names of a store's two tables, the bytes of an id, and the number of index buckets."""

    blocks: str
    index: str
    width: int
    buckets: int


def _packer(width: int):
    """Cut sorted rows (part, doc_id, spot, ids) into blocks; turns count from 1 within a part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, last, turn = None, 0, 0, None, 0
        held: list[tuple] = []
        size = 0

        def block():
            ids = np.array([i or 0 for i, _, _ in held], np.int64)
            lengths = np.array([len(x) // width for _, _, x in held], np.int64)
            return pa.RecordBatch.from_pydict(
                {
                    "block": [part << 24 | number],
                    "part": [part],
                    "before": [before],
                    "n_ids": [int(lengths.sum())],
                    "first_id": pa.array([held[0][0]], pa.int64()),
                    "last_id": pa.array([held[-1][0]], pa.int64()),
                    "last_turn": [abs(held[-1][1])],
                    "doc_ids": [ids.tobytes()],
                    "turns": [np.array([t for _, t, _ in held], np.int64).tobytes()],
                    "lengths": [lengths.tobytes()],
                    "payload": [b"".join(x for _, _, x in held)],
                }
            )

        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if held and (p != part or size + len(ids) > BLOCK):
                    yield block()
                    before += size // width
                    number += 1
                    held, size = [], 0
                if p != part:
                    part, number, before, last, turn = p, 0, 0, None, 0
                # Rows with the same id follow each other; rows without come first.
                turn = turn + 1 if turn and doc_id == last else 1
                last = doc_id
                held.append((doc_id, -turn if doc_id is None else turn, ids))
                size += len(ids)
        if held:
            yield block()

    return work


_BLOCK_COLUMNS = "block long, part long, before long, n_ids long, first_id long, last_id long, last_turn long, doc_ids binary, turns binary, lengths binary, payload binary"
_PLACES = "bucket long, key long, block long, place long, n long, start long"
_INDEX = "bucket long, sizes binary, bits binary, prints binary, blocks binary, places binary, lengths binary, starts binary"


def _places(buckets: int):
    """A row for every document of a block, from its directory."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, turns, lengths = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "turns", "lengths"))
                if row["carried"]:
                    # Earlier parts hold rows of the id this part begins with.
                    first = row["first_id"]
                    turns = turns + np.where((ids == (first or 0)) & ((turns < 0) == (first is None)), row["carried"] * np.sign(turns), 0)
                keys = _keys(ids, turns)
                place = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": _bucket(keys, buckets),
                        "key": keys.view(np.int64),
                        "block": np.full(len(ids), row["block"]),
                        "place": place,
                        "n": lengths,
                        "start": place + row["start"],
                    }
                )

    return work


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = group["key"].to_numpy(np.int64).view(np.uint64)
    function = PerfectHash.over(keys)
    order = np.empty(len(keys), np.int64)
    order[function.slots(keys)] = np.arange(len(keys))
    by_slot = {c: group[c].to_numpy(np.int64)[order].tobytes() for c in ("block", "place", "n", "start")}
    return pd.DataFrame(
        {
            "bucket": [group["bucket"].iloc[0]],
            "sizes": [function.sizes.tobytes()],
            "bits": [np.packbits(function.bits.astype(bool)).tobytes()],
            "prints": [mixed(keys[order], 3).astype(np.uint32).tobytes()],
            "blocks": [by_slot["block"]],
            "places": [by_slot["place"]],
            "lengths": [by_slot["n"]],
            "starts": [by_slot["start"]],
        }
    )


def _parts(ids: pa.Array, spots: np.ndarray, bounds: np.ndarray, unknown: int) -> np.ndarray:
    """The part of every row, ascending with (id, spot): `unknown` parts without id, then one after each bound.

    An id that is several bounds has as many parts, and its rows are dealt to them by spot.
    """
    own = ids.fill_null(0).to_numpy()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    first = np.searchsorted(bounds, own, side="left")
    many = np.maximum(np.searchsorted(bounds, own, side="right") - first, 1)
    first, many = np.where(none, 0, first + unknown), np.where(none, unknown, many)
    place = (spots.view(np.uint64) + np.uint64(1 << 63)) >> np.uint64(32)
    return first + (place * many.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def write_store(
    docs: DataFrame,
    tokenizer_json: str,
    vocabulary: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART,
) -> TokenStore:
    """Encode all documents and store their ids, `end_id` after each.

    Documents lie in ascending order of id, rows without id first, rows with equal ids in an
    order fixed when they are read, so that an id with a third of all rows, or no id, fills many
    parts like anything else. A null text counts as empty: only the end id. An empty table
    makes an empty store. Other columns are not read. The tokenizer's file is sent to every
    task as text; its tokens must not span white space.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = id_and_text(docs, id_col, text_col)
    counted = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (counted["bytes"] or 0) // part_bytes + 1)
    cuts = [k / parts for k in range(1, parts)] or [0.5]
    sketch = rows.agg(F.percentile_approx("doc_id", cuts, 10 * parts).alias("at")).first()["at"]
    bounds = np.array(sketch or [], np.int64)
    unknown = max(1, round(parts * (counted["n"] - counted["known"]) / max(1, counted["n"])))
    json = spark.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches):
        encoder = _encoder(json.value, width)
        for batch in batches:
            ids = [x + end for x in encoder.encode(batch.column(1))]
            own, spot = batch.column(0), batch.column(2)
            part = _parts(own, spot.to_numpy(), bounds, unknown)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), own, spot, pa.array(ids, pa.binary())], names=["part", "doc_id", "spot", "ids"]
            )
        give_back()

    spotted = rows.withColumn("spot", F.xxhash64(F.monotonically_increasing_id()))
    payload = stored(
        spotted.mapInArrow(encode, "part long, doc_id long, spot long, ids binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "doc_id", "spot")
        .mapInArrow(_packer(width), _BLOCK_COLUMNS),
        "block",
    )
    blocks = spark.table(payload)
    # One row for each part: ids in the parts before it, and how many rows of its first id they hold.
    sums = blocks.groupBy("part").agg(
        F.sum("n_ids").alias("n"),
        F.sum(F.length("doc_ids") / 8).cast("long").alias("docs"),
        F.min_by("first_id", "block").alias("first_id"),
        F.max_by("last_id", "block").alias("last_id"),
        F.max_by("last_turn", "block").alias("last_turn"),
    )
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")
    in_order = by_part.rowsBetween(Window.unboundedPreceding, -1)
    of_id = Window.partitionBy("last_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.lag("last_id").over(by_part).eqNullSafe(F.col("first_id"))
    offsets = sums.withColumn("held", F.sum("last_turn").over(of_id)).select(
        "part",
        "first_id",
        F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("offset"),
        F.when(goes_on, F.lag("held", 1, 0).over(by_part)).otherwise(0).alias("carried"),
    )
    total = sums.agg(F.sum("docs")).first()[0] or 0
    buckets = max(1, -(-total // KEYS))
    directory = blocks.select("part", "block", "before", "doc_ids", "turns", "lengths").join(offsets, "part")
    index = stored(
        directory.select(
            "block", (F.col("offset") + F.col("before")).alias("start"), "first_id", "carried", "doc_ids", "turns", "lengths"
        )
        .mapInArrow(_places(buckets), _PLACES)
        .groupBy("bucket")
        .applyInPandas(_build, _INDEX),
        "bucket",
    )
    return TokenStore(payload, index, width, buckets)


def _find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({c: np.empty(0, np.int64) for c in ("key", "block", "place", "n", "start")})
    if not len(asked) or not len(index):
        return empty
    row = index.iloc[0]
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(np.int64)
    keys = asked["key"].to_numpy(np.int64).view(np.uint64)
    slots = PerfectHash(sizes, bits).slots(keys)
    prints = np.frombuffer(row["prints"], np.uint32)
    there = slots >= 0
    there[there] = prints[slots[there]] == mixed(keys[there], 3).astype(np.uint32)
    slots = slots[there]
    column = lambda c: np.frombuffer(row[c], np.int64)[slots]
    return pd.DataFrame(
        {
            "key": keys[there].view(np.int64),
            "block": column("blocks"),
            "place": column("places"),
            "n": column("lengths"),
            "start": column("starts"),
        }
    )


def read_ids(spark: SparkSession, store: TokenStore, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the wanted ids, read through the index.

    An id wanted k times gives its first k rows (all of them if all are wanted); an id that is
    not in the store gives none. ids are little-endian 32-bit numbers; start counts the ids of
    all documents before.
    """
    buckets, kind = store.buckets, f"<u{store.width}"
    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("spot"))
    turns = number_rows(asked, ["doc_id"], ["spot"], "turn").select(
        "doc_id", F.when(F.col("doc_id").isNull(), -F.col("turn")).otherwise(F.col("turn")).cast("long").alias("turn")
    )

    def keyed(batches):
        for batch in batches:
            keys = _keys(batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_pydict(
                {"bucket": _bucket(keys, buckets), "key": keys.view(np.int64), "id": batch.column(0).fill_null(0), "turn": batch.column(1)}
            )

    def find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        return _find(asked, index).merge(asked[["key", "id", "turn"]], on="key")

    def cut(places: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(block["payload"].iloc[0], kind) if len(block) and len(places) else np.empty(0, kind)
        found = [ids[p : p + n].astype("<u4").tobytes() for p, n in zip(places["place"], places["n"])]
        return pd.DataFrame({"id": places["id"], "turn": places["turn"], "start": places["start"], "n_tokens": places["n"], "ids": found})

    places = (
        turns.mapInArrow(keyed, "bucket long, key long, id long, turn long")
        .groupBy("bucket")
        .cogroup(spark.table(store.index).groupBy("bucket"))
        .applyInPandas(find, "key long, block long, place long, n long, start long, id long, turn long")
    )
    found = (
        places.groupBy("block")
        .cogroup(spark.table(store.blocks).select("block", "payload").groupBy("block"))
        .applyInPandas(cut, "id long, turn long, start long, n_tokens long, ids binary")
    )
    return found.select(F.when(F.col("turn") > 0, F.col("id")).alias("doc_id"), "start", "n_tokens", "ids")

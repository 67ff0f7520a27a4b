"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Candidates come from pigeonring filtering. A fingerprint is a ring of four 16-bit segments. If
two fingerprints differ in at most three bits, then from some segment on every chain of l
consecutive segments differs in at most floor(3 l / 4) bits: none in the first, one in the
first two, two in the first three. So a pair meets under the key of a chain start: the start's
segment unchanged and the next one unchanged or with one bit turned. Each fingerprint is filed
once under each start and asks for itself and for its next segment with one zero bit turned to
one (the pair's other side has that bit set, so one direction finds it). The longer chains are
checked before the full Hamming distance.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import give_back, id_and_text, settled
from scoreloom.llm.components import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
SEGMENTS = 4
SLICE = 1 << 16

# Keys with more fingerprints than this are worked off in blocks of pairs instead of by a join.
HOT = 64
BLOCK = 4096

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash over word shingles of a text in UTF-8, as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
        n = len(words) - shingle + 1
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), grams)
    ones = np.zeros(64, np.int64)
    left = n
    while left:
        part = np.fromiter(islice(hashes, SLICE), np.dtype("<u8"), min(SLICE, left))
        left -= len(part)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, over the whole text; a null or wordless text has fp 0. `mark` is the text's xxhash64."""

    def work(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema=_SCHEMA)

    def work_marked(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "mark"])
        give_back()

    rows = id_and_text(docs, id_col, text_col)
    if marked:
        return rows.withColumn("mark", F.xxhash64("text")).mapInArrow(work_marked, "doc_id long, fp long, mark long")
    return rows.mapInArrow(work, "doc_id long, fp long")


def _segment(fp: Column, start: int, k: int) -> Column:
    """The k-th segment after `start` on the ring."""
    at = 16 * ((start + k) % SEGMENTS)
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(0xFFFF))


def _key(fp: Column, start: int, turned: Column | None = None) -> Column:
    second = _segment(fp, start, 1)
    if turned is not None:
        second = second.bitwiseXOR(turned)
    return (_segment(fp, start, 0) * 65536 + second) * SEGMENTS + start


def _homes(fps: DataFrame) -> DataFrame:
    fp = F.col("fp")
    return fps.select(F.explode(F.array(*(_key(fp, s) for s in range(SEGMENTS)))).alias("key"), "fp")


def _guests(fps: DataFrame) -> DataFrame:
    """What each fingerprint asks for beside its own keys: one zero bit of the next segment set."""
    fp = F.col("fp")
    asked = []
    for s in range(SEGMENTS):
        second = _segment(fp, s, 1)
        for j in range(16):
            bit = F.lit(1 << j).cast("long")
            asked.append(F.when(second.bitwiseAND(bit) == 0, _key(fp, s, bit)))
    return fps.select(F.explode(F.array_compact(F.array(*asked))).alias("key"), "fp")


def _within(x: Column, y: Column, start: Column) -> Column:
    """The chain budgets from `start` on, then the full distance."""
    differ = x.bitwiseXOR(y)
    chains = F.lit(False)
    for s in range(SEGMENTS):
        three = F.bit_count(_segment(differ, s, 0)) + F.bit_count(_segment(differ, s, 1)) + F.bit_count(_segment(differ, s, 2))
        chains = chains | ((start == s) & (three <= 2))
    return chains & (F.bit_count(differ) <= DISTANCE)


def linked_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all fingerprints linked directly or not.

    Under ordinary keys every link is an edge. Under a hot key the fingerprints go in blocks,
    each pair of blocks to one task, which returns a spanning forest of the links it finds: no
    group is held whole and no hot group is written out as pairs.
    """
    homes, guests = _homes(fps), _guests(fps)
    sizes = homes.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    hot = settled(sizes.where(F.col("size") > HOT))
    cold = homes.join(hot, "key", "left_anti")
    start = F.pmod(F.col("key"), F.lit(SEGMENTS))
    left, right = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    same = left.join(right, "key").where((F.col("a") < F.col("b")) & _within(F.col("a"), F.col("b"), start))
    asked = guests.select("key", F.col("fp").alias("a")).join(right, "key")
    turned = asked.where(_within(F.col("a"), F.col("b"), start))
    edges = same.select("a", "b").union(turned.select("a", "b"))
    if not hot.isEmpty():
        edges = edges.union(_hot_edges(homes.union(guests), hot))
    return edges


def _hot_edges(members: DataFrame, hot: DataFrame) -> DataFrame:
    counted = members.join(hot.select("key"), "key").join(
        members.join(hot.select("key"), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"
    )
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    blocks = counted.select("key", "fp", own.alias("own"), other.alias("other")).select(
        "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    return blocks.groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long")


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Edges of a spanning forest over the fingerprints of a group within the distance."""
    left = np.unique(group["fp"].to_numpy(np.int64)).view(np.uint64)
    found = []
    queue: list[np.uint64] = []
    while len(left) or queue:
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= DISTANCE
        if near.any():
            reached = left[near]
            found.append((at, reached))
            queue.extend(reached)
            left = left[~near]
    a = np.concatenate([np.full(len(r), x, np.uint64) for x, r in found]) if found else np.empty(0, np.uint64)
    b = np.concatenate([r for _, r in found]) if found else np.empty(0, np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _placed(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp, ...) with the component they belong to."""
    reach = connected_components(linked_pairs(nodes.select("fp")))
    return nodes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id it reaches by links).

    Equal fingerprints are one node, so copies cost nothing in the search. Null and empty texts
    have fingerprint 0 and link like any other. A row without doc_id takes part in its
    component; the component of such rows alone is null. An empty table gives no rows. Other
    columns are not read.
    """
    prints = settled(fingerprints(docs, id_col, text_col))
    placed = _placed(settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they were: the one with the smallest id.

    Rows are told apart by id and text, so rows that share an id but not a component all have
    their own say. A row without id comes after those with one. Of rows with the same id and
    text one stays.
    """
    prints = fingerprints(docs, id_col, text_col, marked=True)
    rows = prints.groupBy("fp", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "copies")
    nodes = settled(rows.groupBy("fp").agg(F.min(first).alias("first")))
    stay = settled(
        _placed(nodes).groupBy("component").agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark"), F.col("first.copies").alias("__copies"))
    )
    found = docs.join(
        stay, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("binary")) == F.col("__mark"))
    )
    if stay.where("__copies > 1").isEmpty():
        return found.select(*(docs[c] for c in docs.columns))
    once = found.where("__copies > 1").dropDuplicates(["__id", "__mark"])
    return found.where("__copies = 1").unionByName(once).drop("__id", "__mark", "__copies")

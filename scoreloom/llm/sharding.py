"""Shards of equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a hash of their text (so equal texts stand together), then by id, then by
an arbitrary fixed number. Splitters are found by counting: every round lays a grid of
candidate boundaries into the bracket of each splitter and sums the exact bytes between them
over all partitions; the bracket shrinks to the grid cell that holds the target, until a
boundary meets the tolerance. Only then are rows exchanged, once, in key order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import settled

SHARDS = 16
PROBES = 512
# Of a shard's bytes: how far a splitter may lie from its target, and how large a group of
# equal texts may be that is kept whole at a boundary.
TOLERANCE = 0.001
GROUP_SHARE = 0.01

_KEY = ("h", "d", "m")
_LOW = -(1 << 63)


@dataclass(frozen=True)
class _Bracket:
    """Keys that start with `prefix` and go on with a number in [low, high); `below` bytes lie before."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int

    @property
    def width(self) -> int:
        return -(-(self.high - self.low) // PROBES)

    def holds(self) -> Column:
        column = F.col(_KEY[len(self.prefix)])
        inside = (column >= F.lit(self.low)) & (column <= F.lit(self.high - 1))
        for name, value in zip(_KEY, self.prefix):
            inside = inside & (F.col(name) == F.lit(value))
        return inside

    def cell(self) -> Column:
        column = _KEY[len(self.prefix)]
        if self.high - self.low >= 1 << 62:
            column = f"CAST({column} AS DECIMAL(20, 0))"
        return F.expr(f"CAST(({column} - ({self.low})) DIV {self.width} AS INT)")


def _counted(rows: DataFrame, brackets: list[_Bracket]) -> dict[_Bracket, list[tuple[int, int]]]:
    """Bytes in every cell of each bracket's grid that has some: a few hundred sums a bracket."""
    of, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, b in enumerate(brackets):
        of = F.when(b.holds(), F.lit(k)).otherwise(of)
        cell = F.when(b.holds(), b.cell()).otherwise(cell)
    sums = (
        rows.select(of.alias("of"), cell.alias("cell"), "size")
        .where("of IS NOT NULL")
        .groupBy("of", "cell")
        .agg(F.sum("size").alias("bytes"))
        .collect()
    )
    out: dict[_Bracket, list[tuple[int, int]]] = {b: [] for b in brackets}
    for row in sorted(sums, key=lambda r: (r["of"], r["cell"])):
        out[brackets[row["of"]]].append((row["cell"], row["bytes"]))
    return out


def _ranges(rows: DataFrame, brackets: list[_Bracket]) -> dict[_Bracket, _Bracket]:
    """Brackets of a new key column, narrowed to the values that occur."""
    found = rows.agg(
        *(
            f(F.when(b.holds(), F.col(_KEY[len(b.prefix)])))
            for b in brackets
            for f in (F.min, F.max)
        )
    ).first()
    return {
        b: _Bracket(b.prefix, found[2 * k], found[2 * k + 1] + 1, b.below) for k, b in enumerate(brackets)
    }


def find_splitters(rows: DataFrame, shards: int, total: int) -> list[tuple[int, int, int]]:
    """The first key of each shard but the first; rows have h (not negative), d, m and size."""
    share = total / shards
    open_ = {k: _Bracket((), 0, 1 << 63, 0) for k in range(1, shards)}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        sums = _counted(rows, list(dict.fromkeys(open_.values())))
        deeper: dict[int, _Bracket] = {}
        for k, b in list(open_.items()):
            target, below = share * k, b.below
            cells = sums[b]
            for at, (cell, here) in enumerate(cells):
                if below + here >= target or at == len(cells) - 1:
                    break
                below += here
            start = b.low + cell * b.width
            stop = min(start + b.width, b.high)
            near, error = min(
                ((start, abs(target - below)), (stop, abs(below + here - target))), key=lambda x: x[1]
            )
            last_column = len(b.prefix) == len(_KEY) - 1
            whole = b.width == 1 and (last_column or not b.prefix and here <= GROUP_SHARE * share)
            if error <= TOLERANCE * share or whole:
                done[k] = (*b.prefix, near)
                del open_[k]
            elif b.width == 1:
                deeper[k] = _Bracket((*b.prefix, start), _LOW, -_LOW, below)
                del open_[k]
            else:
                open_[k] = _Bracket(b.prefix, start, stop, below)
        if deeper:
            narrowed = _ranges(rows, list(dict.fromkeys(deeper.values())))
            open_ |= {k: narrowed[b] for k, b in deeper.items()}
    return [(*done[k], *(_LOW,) * (len(_KEY) - len(done[k]))) for k in sorted(done)]


def _from(first: tuple[int, int, int]) -> Column:
    """Is a row's key at or after this one?"""
    h, d, m = first
    if h >= 1 << 63:
        return F.lit(False)
    later = (F.col("d") > F.lit(d)) | ((F.col("d") == F.lit(d)) & (F.col("m") >= F.lit(m)))
    if d == _LOW and m == _LOW:
        later = F.lit(True)
    return (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & later)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, shards nearly equal in bytes.

    size is the text's UTF-8 bytes plus 1. A null text has no bytes and the checksum of an
    empty one. Rows without id come first among equal texts. Repeated rows are told apart by a
    number fixed when they are read, so a hot row can be split like anything else. Equal texts
    share a shard unless that would make a shard uneven; slots follow the key order. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = settled(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("d"),
            F.monotonically_increasing_id().alias("m"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0]
    shard = F.lit(0)
    for first in find_splitters(rows, shards, total) if total else []:
        shard = shard + _from(first).cast("int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(
        rows.withColumn("shard", shard)
        .repartitionByRange(parts, "shard", *_KEY)
        .sortWithinPartitions("shard", *_KEY)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
        .drop(*_KEY)
    )
    # One row for each partition and shard in it (no more than partitions plus shards, whatever
    # the input): where its numbers start, and what came before.
    starts = placed.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select(
        "shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot")
    )

"""Stems by a vocabulary: every distinct token of all texts is stemmed once, and joined back.

Token lists are dictionary-encoded batch by batch, so that what meets the vocabulary is a batch's
dictionary and not its occurrences; a token that stands in every text is one row per batch. A batch
stays one row (its codes) until its stems have come back. Spark bounds it by rows and bytes
(`spark.sql.execution.arrow.maxRecordsPerBatch`, `maxBytesPerBatch`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.rouge import stem_tokens
from scoreloom.session import settle, small_side

PACKED = "batch string, keys binary, lengths array<int>, codes array<int>, dictionary array<string>"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch: its keys, the length of each token list (-1: NULL), codes, and the dictionary."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        lists = batch.column("tokens")
        lengths = pc.fill_null(pc.list_value_length(lists), -1)
        words = pc.dictionary_encode(lists.flatten())
        keys = batch.drop_columns("tokens")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, keys.schema) as stream:
            stream.write_batch(keys)
        yield pa.RecordBatch.from_pydict(
            {
                "batch": [f"{part}-{number}"],
                "keys": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                "lengths": _one_list(lengths.cast(pa.int32())),
                "codes": _one_list(words.indices.cast(pa.int32())),
                "dictionary": _one_list(words.dictionary.cast(pa.string())),
            }
        )


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every packed batch, with the stem of each token in place of its code."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = pa.ipc.open_stream(batch.column("keys")[i].as_py()).read_next_batch()
            stems = batch.column("stems")[i].values
            codes = batch.column("codes")[i].values
            # A batch without a token has no stems to take from.
            found = stems.take(codes) if len(codes) else pa.array([], pa.string())
            lengths = batch.column("lengths")[i].values
            ends = pc.cumulative_sum(pc.max_element_wise(lengths, pa.scalar(0, pa.int32())))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
            lists = pa.ListArray.from_arrays(offsets, found.cast(pa.string()), mask=pc.equal(lengths, -1))
            yield pa.RecordBatch.from_arrays([*keys.columns, lists], [*keys.schema.names, "stems"])


def vocabulary_of(dictionaries: DataFrame) -> DataFrame:
    """(token, stem) of every distinct token in a column `token`; no NULLs, each stemmed once."""
    return dictionaries.where("token IS NOT NULL").select("token").distinct().withColumn("stem", stem_tokens("token"))


def stemmed_by_vocabulary(df: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """keys and `stems`: the stemmed tokens of every row, in order.

    A NULL token list stays NULL and an empty one empty; rows that share keys, or have NULL keys,
    each keep their own. The vocabulary is broadcast only after it was counted.
    """
    rows = df.select(*keys, tokens.alias("tokens"))
    packed = settle(rows.mapInArrow(_encoded, PACKED))
    entries = packed.select("batch", F.posexplode("dictionary").alias("place", "token"))
    vocabulary = settle(vocabulary_of(entries))
    stems = (
        entries.join(small_side(vocabulary), "token")
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("place", "stem"))).alias("placed"))
        .select("batch", F.col("placed.stem").alias("stems"))
    )
    whole = packed.drop("dictionary").join(stems, "batch", "left")
    filled = whole.withColumn("stems", F.coalesce("stems", F.array().cast("array<string>")))
    schema = rows.drop("tokens").schema.add("stems", T.ArrayType(T.StringType()))
    return filled.mapInArrow(_decoded, schema)

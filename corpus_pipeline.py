"""From raw documents to token ids: the stages in order, each written and read back in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, mixing, repeats, simhash, toxicity
from scoreloom.llm.queries import WEIGHTS
from scoreloom.session import attach, scratch

# The mix is cut from what is there: no document is taken twice, and the weights decide which
# fifth of the words is left out.
MIX = {"budget": 0.8, "max_epochs": 1}
# Bytes of text that a task works on at once; five stages share the workers' memory.
CHUNK = 3 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of what comes in."""
    attach(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group that SimHash links (3-word shingles, at most 3 bits), the document with the smallest id stays."""
    attach(spark)
    return simhash.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the texts."""
    attach(spark)
    return repeats.drop_repeats(docs, chunk=CHUNK)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources are brought to their weights."""
    attach(spark)
    return mixing.mixed(docs, WEIGHTS, **MIX)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids of the public multilingual ranks, and their text's digest."""
    attach(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk=CHUNK), ranks)
    return decoded.select(
        "doc_id", F.expr("length(ids) DIV 4").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

# A trained model, fingerprints and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs

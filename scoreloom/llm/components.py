"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import settled


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node each node reaches: rows (node, component), one per node of an edge.

    edges has two columns `a`, `b` of one integer type; direction, repeats, loops and nulls do
    not matter (edges with a null are ignored). Alternates the large-star and small-star
    contractions: every node's neighbours are tied to the smallest among them, so paths shrink
    geometrically and no neighbourhood is ever gathered in one place, only its minimum. Each
    round is cut off in the shared checkpoint folder; the last round is one that changes nothing.
    """
    current = settled(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        current = settled(_small_star(_large_star(current)))
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(current.select("b", "b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

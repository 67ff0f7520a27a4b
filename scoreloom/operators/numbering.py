"""Running numbers and first-n per group without putting a large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import settle

SALTS = 64


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """Append 1, 2, 3, ... within each group of `by`, in ascending `order` (must be unique).

    Rows are exchanged once, by ranges of group and order, and kept in the shared folder in that
    order; a hot group fills many partitions. A row's number is its place in its partition,
    shifted by what earlier partitions hold of the group: one small row per partition and group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*by) if by else F.lit(0)
    placed = settle(
        df.repartitionByRange(parts, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_group": group, "_part": F.shiftright("_at", 33)})
    )
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_group", "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
        .select(
            "_group",
            "_part",
            (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        )
    )
    return placed.join(shifts, ["_group", "_part"]).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(name)
    )


def first_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, salts: int = SALTS
) -> DataFrame:
    """The first n rows of each group. Salted parts are cut first, so the last step
    sees at most salts * n rows of a group however large it is."""
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    parts = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_place", F.row_number().over(parts))
        .where(F.col("_place") <= n)
        .withColumn("_place", F.row_number().over(whole))
        .where(F.col("_place") <= n)
        .drop("_salt", "_place")
    )

"""The results table and the summary table: read, write, append, export."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.schemas import RESULT_KEYS, RESULTS

PARTITIONS = ["benchmark", "policy_name"]
ROW_GROUP = 32 << 20
# About 8 MB of short results in a CSV file, 500 MB if every row has 20,000 letters.
CSV_ROWS = 25_000


def conform(df: DataFrame) -> DataFrame:
    """Cast to the results schema, add missing columns as NULL, keep extra columns last."""
    known = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RESULTS
    ]
    extra = [c for c in df.columns if c not in RESULTS.fieldNames()]
    return df.select(*known, *extra)


def scan_results(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """The table's known columns, then those of `extra`: metrics of the user's own, NULL where a run lacks them."""
    schema = T.StructType([*RESULTS.fields, *(extra.fields if extra else ())])
    return spark.read.schema(schema).parquet(path).select(schema.fieldNames())


def scan_open_results(spark: SparkSession, path: str) -> DataFrame:
    """The table's known columns, then every other column any of its files has, by name; NULL where a run lacks it.

    The files' own schemas are merged, so metrics of the user's own need no declaration. One name
    must have one type in all runs.
    """
    found = spark.read.option("mergeSchema", "true").parquet(path)
    known = [
        (F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULTS
    ]
    return found.select(*known, *sorted(set(found.columns) - set(RESULTS.fieldNames())))


def stored_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys and `error` of what the table holds; None where there is no table yet."""
    try:
        return scan_results(spark, path).select(*RESULT_KEYS, "error")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_routed(df: DataFrame, reject: Column, path: str) -> None:
    """One job writes usable rows to the folder route=good and the others to route=rejected.

    reject is the reason, NULL for a usable row.
    """
    routed = df.withColumn("route", F.when(reject.isNull(), "good").otherwise("rejected"))
    routed.write.mode("overwrite").partitionBy("route").parquet(path)


def scan_routed(spark: SparkSession, path: str, schema: T.StructType, route: str | None = None) -> DataFrame:
    """What :func:`write_routed` stored: one route, read from its folder alone, or both with a column `route`."""
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("route", T.StringType())])).parquet(path)
    return stored if route is None else stored.where(F.col("route") == route).drop("route")


def write_folders(
    df: DataFrame,
    path: str,
    mode: str,
    partitions: Sequence[str] = PARTITIONS,
    compression: str = "zstd",
    row_group: int = ROW_GROUP,
) -> None:
    """Each task writes its own rows, a file per folder, so a hot policy fills files of many tasks and no row is shuffled.

    A task has all its files open at once (`session.SETTINGS`); small row groups bound what they hold in memory.
    """
    options = {"parquet.block.size": row_group, "compression": compression}
    df.write.mode(mode).partitionBy(*partitions).options(**options).parquet(path)


def _write(df: DataFrame, path: str, mode: str) -> None:
    write_folders(conform(df), path, mode)


def write_results(df: DataFrame, path: str) -> None:
    """Replace the table; partitioned so that suite and policy filters prune folders."""
    _write(df, path, "overwrite")


def append_results(df: DataFrame, path: str) -> None:
    """Add files to the table; what is there is neither read nor rewritten."""
    _write(df, path, "append")


def union_runs(runs: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns a run lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


# CSV must not trim texts, and tells NULL (a bare \N), '' (quoted) and texts apart; a text that
# itself begins with a backslash gets one more.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _texts(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(*(change(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def export_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV that keeps quotes, line breaks, blanks, empty texts and NULLs.

    A text may hold line breaks, so a file can only be read from its start, by one task: files are kept small, and
    `compression` (gzip, say) costs no parallel reading. `scan_csv` reads either.
    """
    marked = _texts(df, lambda c: F.when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c))
    options = {"emptyValue": '""', "maxRecordsPerFile": CSV_ROWS, "compression": compression}
    marked.write.mode("overwrite").options(**_CSV, **options).csv(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    scanned = spark.read.schema(schema).options(**_CSV, emptyValue="", multiLine=True).csv(path)
    return _texts(scanned, lambda c: F.when(c.startswith("\\\\"), F.substring(c, 2, F.length(c))).otherwise(c))


def materialize_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def materialize_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Save as a managed table, or as an external one at `path`."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def scan_summary(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The summary table, or an empty frame of its schema when it was never built."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)

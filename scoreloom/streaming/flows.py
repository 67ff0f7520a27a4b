"""Structured Streaming forms of generation metrics, result ingestion and the run trend."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scoreloom.operators.filters import run_time
from scoreloom.plans.generation import chunk_aggregates, timings
from scoreloom.plans.reports import HEADLINE, means
from scoreloom.schemas import RESULT_KEYS, RESULTS
from scoreloom.session import BROADCAST_ROWS
from scoreloom.sources.results import PARTITIONS, conform, write_folders

# Tasks for each core when a batch is written to folders.
TURNS = 4
# A task holds that much for each of its open files, beside what a batch's joins need.
BATCH_ROW_GROUP = 8 << 20


def stream_generation_metrics(
    chunks: DataFrame, delay: str = "1 hour", gap: str = "1 day"
) -> DataFrame:
    """Timings per request, emitted once the request has been silent for `gap`.

    Use append mode: state is dropped when the watermark passes the session end, and chunks
    that come later than that no longer count. :func:`append_facts` with :func:`timing_facts`
    loses none.
    """
    sessions = (
        chunks.withWatermark("chunk_ts", delay)
        .groupBy("request_id", F.session_window("chunk_ts", gap).alias("session"))
        .agg(*chunk_aggregates())
    )
    return timings(sessions, "request_id")


def stream_distinct_results(results: DataFrame, remember: str = "1 day") -> DataFrame:
    """Drop redelivered rows seen within `remember`.

    The watermark follows arrival, not run time, so no row is ever late and none is lost.
    """
    return (
        results.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", remember)
        .dropDuplicatesWithinWatermark(RESULT_KEYS)
        .drop("_arrived")
    )


def stream_run_trend(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """Headline means per hour of run time.

    An hour stays open until the watermark is `delay` past it; choose the delay by how late
    runs may arrive, since rows later than that no longer count. :func:`append_facts` with
    :func:`trend_facts` loses none.
    """
    timed = results.withColumn("run_at", run_time(F.col("timestamp")))
    return (
        timed.withWatermark("run_at", delay)
        .groupBy(F.window("run_at", "1 hour").alias("hour"))
        .agg(F.count("*").alias("samples"), *means([*HEADLINE, "f1"]))
        .select(F.col("hour.start").alias("hour_start"), "samples", *_trend_means())
    )


def _trend_means() -> list[str]:
    return [f"mean_{c}" for c in [*HEADLINE, "f1"]]


def timing_facts(chunks: DataFrame) -> DataFrame:
    """What a batch of chunks says about its requests; :func:`merged_timings` adds batches up."""
    return chunks.groupBy("request_id").agg(*chunk_aggregates())


def merged_timings(facts: DataFrame, delay: str | None = "1 hour", gap: str = "1 day") -> DataFrame:
    """Timings per request from the facts of all batches, however late their chunks came.

    Requests that were silent for `gap` when the newest chunk was `delay` old; with `delay`
    None every request, also those that may go on.
    """
    whole = facts.groupBy("request_id").agg(
        F.min("started_at").alias("started_at"),
        F.min("first_ts").alias("first_ts"),
        F.max("end_ts").alias("end_ts"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    if delay is not None:
        newest = facts.agg(F.max("end_ts").alias("_newest"))
        silent = F.expr(f"end_ts + INTERVAL {gap} <= _newest - INTERVAL {delay}")
        whole = whole.crossJoin(F.broadcast(newest)).where(silent)
    return timings(whole, "request_id")


def trend_facts(results: DataFrame) -> DataFrame:
    """Rows, sums and counts of a batch per hour of run time; :func:`merged_trend` adds batches up."""
    micros = F.unix_micros(run_time(F.col("timestamp")))
    hour = F.timestamp_micros(micros - F.pmod(micros, F.lit(3_600_000_000)))
    columns = [*HEADLINE, "f1"]
    return results.groupBy(hour.alias("hour_start")).agg(
        F.count("*").alias("samples"),
        *(F.sum(c).alias(f"sum_{c}") for c in columns),
        *(F.count(c).alias(f"count_{c}") for c in columns),
    )


def merged_trend(facts: DataFrame) -> DataFrame:
    """Headline means per hour from the facts of all batches, however late their rows came."""
    return facts.groupBy("hour_start").agg(
        F.sum("samples").alias("samples"),
        *(F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")).alias(f"mean_{c}") for c in [*HEADLINE, "f1"]),
    )


def append_facts(
    stream: DataFrame, facts: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Write what `facts` makes of each batch, one folder per batch; no watermark, so no row is late."""
    write = _batch_writer(path)
    return (
        stream.writeStream.foreachBatch(lambda batch, number: write(facts(batch), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, appending closed results exactly once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def _batch_writer(path: str, *partitions: str, compression: str = "zstd") -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so replays do not double rows.
        if partitions:
            # A stateful batch has a part for each of its many state stores, and adaptive planning is off there;
            # a task takes several of them, so that files are few.
            batch = batch.coalesce(TURNS * batch.sparkSession.sparkContext.defaultParallelism)
        write_folders(batch, f"{path}/batch_id={batch_id}", "overwrite", partitions, compression)

    return write


def append_batches(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving results to a results table, one folder per batch."""
    write = _batch_writer(path, "benchmark", "policy_name", compression="snappy")
    return (
        results.writeStream.foreachBatch(lambda batch, number: write(conform(batch), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose result keys are, or are not, among a few; NULL keys are equal."""
    few = F.broadcast(keys.select(*(F.col(k).alias(f"_{k}") for k in RESULT_KEYS)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in RESULT_KEYS))
    return rows.join(few, same, how)


def unseen(arrived: DataFrame, seen: DataFrame | None) -> DataFrame:
    """One row for each result key in `arrived` that `seen` lacks; rows with a NULL in their key are never seen.

    Keys alone are counted and compared first. Where few of them are new, or few are seen or repeated, those go to
    all tasks and no whole row is shuffled.
    """
    keys = arrived.groupBy(*RESULT_KEYS).agg(F.count("*").alias("_n"))
    if seen is None:
        judged = keys.withColumn("_old", F.lit(False))
    else:
        old = seen.distinct().withColumn("_old", F.lit(True))
        judged = keys.join(old, RESULT_KEYS, "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    new, marked = ~F.col("_old"), F.col("_old") | (F.col("_n") > 1)
    counts = judged.agg(F.count_if(new).alias("new"), F.count_if(marked).alias("marked")).first()
    if counts["new"] <= BROADCAST_ROWS:
        return _matching(arrived, judged.where(new), "left_semi").dropDuplicates(RESULT_KEYS)
    if counts["marked"] == 0:
        return arrived
    if counts["marked"] <= BROADCAST_ROWS:
        once = _matching(arrived, judged.where(marked), "left_anti")
        thinned = _matching(arrived, judged.where(marked & new), "left_semi").dropDuplicates(RESULT_KEYS)
        return once.unionByName(thinned)
    whole = arrived.dropDuplicates(RESULT_KEYS)
    return whole if seen is None else whole.join(seen, RESULT_KEYS, "left_anti")


def _moved(spark: SparkSession, path: str, to: str | None) -> None:
    """A folder takes the place of another, or goes."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if to is None:
        files.delete(place(path), True)
        return
    files.delete(place(to), True)
    if not files.rename(place(path), place(to)):
        raise OSError(f"cannot rename {path} to {to}")


def append_unseen(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving results that the table has no row for, however long ago that row came.

    The keys of a batch are looked up in the stored folders of its own suites and policies, so
    nothing is kept in memory and no redelivery is too late to be noticed. A replayed batch does not see
    what it wrote itself, and writes the same again. A batch is computed once, into a hidden folder of the
    table, and its keys are read from there; where all of it is new, that folder becomes the batch's own.
    """
    schema = T.StructType([*(RESULTS[k] for k in RESULT_KEYS), T.StructField("batch_id", T.LongType())])

    def append(batch: DataFrame, number: int) -> None:
        spark, staged, own = batch.sparkSession, f"{path}/_staged-{number}", f"{path}/batch_id={number}"
        rows = conform(batch).coalesce(TURNS * spark.sparkContext.defaultParallelism)
        try:
            stored = spark.read.schema(schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None
        write_folders(rows, staged, "overwrite", row_group=BATCH_ROW_GROUP)
        arrived = spark.read.schema(rows.schema).parquet(staged).select(*rows.columns)
        seen = None
        if stored is not None:
            # A batch touches at most suites times policies folders.
            folders = arrived.select(*PARTITIONS).distinct().collect()
            inside = F.lit(False)
            for folder in folders:
                inside = inside | ((F.col("benchmark") == folder["benchmark"]) & (F.col("policy_name") == folder["policy_name"]))
            seen = stored.where(inside & (F.col("batch_id") != number)).select(*RESULT_KEYS)
        fresh = unseen(arrived, seen)
        if fresh is arrived:
            _moved(spark, staged, own)
        else:
            write_folders(fresh, own, "overwrite", row_group=BATCH_ROW_GROUP)
            _moved(spark, staged, None)

    return (
        results.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_batches(trend: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the groups each batch changed; read them with :func:`latest`."""
    return (
        trend.writeStream.foreachBatch(_batch_writer(path))
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(upserts: DataFrame, key: str) -> DataFrame:
    """The newest version of each group."""
    values = [c for c in upserts.columns if c not in (key, "batch_id")]
    newest = F.max_by(F.struct(*values), F.col("batch_id")).alias("row")
    return upserts.groupBy(key).agg(newest).select(key, "row.*")

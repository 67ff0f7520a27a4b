"""Requests as a stateful stream: closed once by an event-time timer, late chunks to a side output."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scoreloom.functions.text import word_count

FACTS = "started_at BIGINT, first_ts BIGINT, end_ts BIGINT, total_tokens BIGINT"
OUTPUT = f"request_id STRING, outcome STRING, {FACTS}"
_COLUMNS = ["request_id", "started_at", "first_ts", "end_ts", "total_tokens"]
# A group of requests as columns of one length, and the time of its timer.
GROUP = (
    "timer BIGINT, request_id ARRAY<STRING>, closed ARRAY<BOOLEAN>, started_at ARRAY<BIGINT>, "
    "first_ts ARRAY<BIGINT>, end_ts ARRAY<BIGINT>, total_tokens ARRAY<BIGINT>"
)
CLOSED, LATE, OPEN = "closed", "late", "open"
# Stands for a missing time inside the stateful step: later than every time, and pandas keeps it exact.
_NEVER = 2**63 - 1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Facts = tuple[int, int, int, int]


def _merged(one: Facts, other: Facts) -> Facts:
    """Facts of two parts of a request: earliest start and word, latest chunk, all tokens."""
    return min(one[0], other[0]), min(one[1], other[1]), max(one[2], other[2]), one[3] + other[3]


def _emitted(requests: dict[str | None, Facts], outcome: str) -> pd.DataFrame:
    columns = {"request_id": list(requests), "outcome": outcome, **dict(zip(_COLUMNS[1:], zip(*requests.values())))}
    return pd.DataFrame(columns)


class RequestSessions(StatefulProcessor):
    """Keeps four numbers for each open request, and all requests of a group as one value with one timer.

    A call to the state is a round trip, so a batch makes a few for each group it touches and none for a request.

    A request is open until the watermark is `gap` past its newest chunk; a timer then emits it
    as 'closed' and leaves a mark, dropped when the watermark has passed by another `gap`. The chunks of a
    request in one batch are judged together, by the newest of them: while the request is open they are
    added to it; otherwise they are 'late' if they belong to the request that closed or are `gap`
    behind the watermark, and open the request anew if not.
    """

    def __init__(self, gap: timedelta):
        self.gap = gap // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("requests", GROUP)

    def _due(self, facts: Facts, closed: bool) -> int:
        """When the watermark closes an open request, or drops the mark of a closed one."""
        return -(-facts[2] // 1000) + self.gap * (2 if closed else 1)

    def _load(self) -> tuple[int | None, dict[str | None, tuple[bool, Facts]]]:
        """The group's timer, and for each of its requests whether it closed, and its facts."""
        kept = self.group.get()
        if kept is None:
            return None, {}
        timer, ids, closed, *facts = kept
        return timer, dict(zip(ids, zip(closed, zip(*facts))))

    def _store(self, timer: int | None, requests: dict[str | None, tuple[bool, Facts]]) -> None:
        """Keep the group; its timer is never later than the first of its requests is due."""
        if not requests:
            self.group.clear()
            return
        due = min(self._due(facts, closed) for closed, facts in requests.values())
        # Where requests went on, the timer stays and is moved on when it fires.
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        closed, facts = zip(*requests.values())
        self.group.update((timer, list(requests), list(closed), *(list(column) for column in zip(*facts))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        arrived: dict[str | None, Facts] = {}
        for frame in rows:
            for request, *part in zip(*(frame[c].tolist() for c in _COLUMNS)):
                arrived[request] = _merged(arrived[request], part) if request in arrived else tuple(part)
        timer, requests = self._load()
        late = {}
        for request, facts in arrived.items():
            closed, former = requests.get(request, (None, None))
            if closed is False:
                requests[request] = (False, _merged(former, facts))
                continue
            gone = self._due(facts, False) <= watermark
            after_close = closed and facts[2] <= former[2] + 1000 * self.gap
            if gone or after_close:
                late[request] = facts
            else:
                requests[request] = (False, facts)
        if len(late) < len(arrived):
            self._store(timer, requests)
        if late:
            yield _emitted(late, LATE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        _, requests = self._load()
        left, done = {}, {}
        for request, (closed, facts) in requests.items():
            if not closed and self._due(facts, False) <= watermark:
                # A chunk that touches this request is `gap` behind the watermark once the mark is dropped.
                closed, done[request] = True, facts
            if self._due(facts, closed) > watermark:
                left[request] = (closed, facts)
        # The timer that fired is deleted after this call.
        self._store(None, left)
        if done:
            yield _emitted(done, CLOSED)

    def close(self) -> None:
        pass


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per request and batch, so that a request of many chunks is not shuffled chunk by chunk."""
    wanted = [("started_at", "min"), ("first_ts", "min"), ("end_ts", "max"), ("total_tokens", "sum")]
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by("request_id").aggregate(wanted)
        named = grouped.select(["request_id", *(f"{c}_{f}" for c, f in wanted)])
        yield from named.rename_columns(["request_id", *(c for c, _ in wanted)]).to_batches()


def _timed(column: str) -> Column:
    """Times as they leave the stateful step."""
    return F.nullif(F.col(column), F.lit(_NEVER)).alias(column)


def stream_requests(
    chunks: DataFrame, delay: str = "1 hour", gap: timedelta = timedelta(days=1), groups: int = 1 << 13
) -> DataFrame:
    """Facts of requests as they close, and of chunks that came too late, told apart by `outcome`.

    Times are microseconds. No chunk is dropped: the watermark only moves the timers, since its column ends
    before the stateful step. A chunk without time cannot be placed and is left out.

    The state keeps requests in `groups` by a hash of their ids. A batch rewrites the groups it touches, so more
    groups suit small batches over many open requests; the number cannot change while a checkpoint is in use.
    """
    spoken = F.coalesce(F.col("content"), F.lit("")) != ""
    at = F.unix_micros("chunk_ts")
    parts = (
        chunks.where(F.col("chunk_ts").isNotNull())
        .withWatermark("chunk_ts", delay)
        .select(
            "request_id",
            F.coalesce(F.unix_micros("started_at"), F.lit(_NEVER)).alias("started_at"),
            F.when(spoken, at).otherwise(F.lit(_NEVER)).alias("first_ts"),
            at.alias("end_ts"),
            F.when(spoken, word_count(F.col("content"))).otherwise(F.lit(0)).cast("long").alias("total_tokens"),
        )
        .mapInArrow(_partial, f"request_id STRING, {FACTS}")
    )
    grouped = parts.withColumn("slot", F.pmod(F.xxhash64("request_id"), F.lit(groups))).groupBy("slot")
    judged = grouped.transformWithStateInPandas(RequestSessions(gap), OUTPUT, "Append", "EventTime")
    return judged.select("request_id", "outcome", _timed("started_at"), _timed("first_ts"), "end_ts", "total_tokens")


def append_requests(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived; closed requests and late chunks go to folders of their own under `path`."""
    spark = requests.sparkSession
    former = spark.conf.get(_PROVIDER)
    # The query copies the settings when it starts.
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            requests.writeStream.format("parquet")
            .outputMode("append")
            .partitionBy("outcome")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )
    finally:
        spark.conf.set(_PROVIDER, former)


def written_requests(spark: SparkSession, path: str) -> DataFrame:
    """Closed requests and late chunks written so far."""
    return spark.read.schema(OUTPUT).parquet(path)


def open_requests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Requests still open, read from the state of the last finished batch."""
    groups = spark.read.format("statestore").option("stateVarName", "requests").load(checkpoint).select("value.*")
    kept = groups.select(F.inline(F.arrays_zip("closed", *_COLUMNS))).where(~F.col("closed"))
    facts = (_timed("started_at"), _timed("first_ts"), "end_ts", "total_tokens")
    return kept.select("request_id", F.lit(OPEN).alias("outcome"), *facts)


def whole_requests(facts: DataFrame) -> DataFrame:
    """Closed, late and open parts added up per request, with timestamps: the facts of a batch over all chunks."""
    return facts.groupBy("request_id").agg(
        *(F.timestamp_micros(F.min(c)).alias(c) for c in ("started_at", "first_ts")),
        F.timestamp_micros(F.max("end_ts")).alias("end_ts"),
        F.sum("total_tokens").alias("total_tokens"),
    )

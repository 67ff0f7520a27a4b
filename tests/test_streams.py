"""The stateful request stream: nothing counted twice, nothing lost."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scoreloom.streaming import requests
from scoreloom.streaming.flows import timing_facts

CHUNKS = "request_id STRING, started_at TIMESTAMP, chunk_ts TIMESTAMP, content STRING"
NOON = datetime(2024, 5, 1, 12)


def chunk(request, hours, content="two words"):
    return (request, NOON, None if hours is None else NOON + timedelta(hours=hours), content)


def deliver(spark, root, rows, number):
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{root}/in/arrival={number}")
    arriving = spark.readStream.schema(CHUNKS).parquet(f"{root}/in/arrival=*")
    stream = requests.stream_requests(arriving, "1 hour", timedelta(hours=4))
    query = requests.append_requests(stream, f"{root}/out", f"{root}/log")
    query.awaitTermination()
    return query


def written(spark, root):
    rows = requests.written_requests(spark, f"{root}/out").collect()
    return sorted(((r.request_id, r.outcome, r.total_tokens) for r in rows), key=str)


def still_open(spark, root):
    rows = requests.open_requests(spark, f"{root}/log").collect()
    return sorted(((r.request_id, r.total_tokens) for r in rows), key=str)


def test_requests_close_once_and_late_chunks_go_aside(spark, tmp_path):
    root, arrivals = str(tmp_path), []
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def arrive(*rows):
        arrivals.extend(rows)
        return deliver(spark, root, rows, len(arrivals))

    # The watermark goes to 5 h: a ends at 0.5 h and closes at 4.5 h; b goes on.
    arrive(chunk("a", 0), chunk("a", 0.5, ""), chunk("b", 3), chunk("clock", 6), chunk("untimed", None))
    assert written(spark, root) == [("a", "closed", 2)]
    assert still_open(spark, root) == [("b", 2), ("clock", 2)]
    # After the close: a chunk that touches a and one of a request never seen, both late; b is open, so its old chunk counts.
    arrive(chunk("a", 4.4), chunk("new", 0.9), chunk("b", 1))
    assert written(spark, root) == [("a", "closed", 2), ("a", "late", 2), ("new", "late", 2)]
    assert still_open(spark, root) == [("b", 4), ("clock", 2)]
    # The watermark goes to 49 h: all close. A request that comes back much later is opened anew.
    arrive(chunk("clock", 50), chunk("a", 49.5), chunk(None, 49))
    assert [r for r in written(spark, root) if r[1] == "closed"] == [("a", "closed", 2), ("b", "closed", 4)]
    assert ("a", 2) in still_open(spark, root)
    # Closed marks are dropped, too: only what is open is kept.
    query = arrive(chunk("clock", 100))
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal < 10
    assert all(op.numRowsDroppedByWatermark == 0 for p in query.recentProgress for op in p.stateOperators)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider

    parts = requests.written_requests(spark, f"{root}/out").unionByName(requests.open_requests(spark, f"{root}/log"))
    timed = spark.createDataFrame(arrivals, CHUNKS).where(F.col("chunk_ts").isNotNull())
    whole, batch = requests.whole_requests(parts), timing_facts(timed)
    assert whole.columns == batch.columns
    assert whole.count() == batch.count() and whole.exceptAll(batch).count() == 0


def test_hot_request_is_shuffled_as_few_rows(spark, tmp_path):
    rows = [chunk("hot", i / 100_000) for i in range(5000)] + [chunk("cold", 0, "")]
    query = deliver(spark, str(tmp_path), rows, 0)
    assert still_open(spark, str(tmp_path)) == [("cold", 0), ("hot", 10_000)]
    # Partial facts reach the state, not chunks.
    assert query.recentProgress[0].stateOperators[0].numRowsUpdated < 100
    frame = requests.stream_requests(spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/in/arrival=*"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("MapInArrow") < plan.index("EventTimeWatermark")


def judged(arrivals, hour=3600, gap=4 * 3600):
    """Closed, late and open parts by one request at a time, in seconds since noon."""
    clock, alive, marks, out = None, {}, {}, []
    for rows in arrivals:
        parts = {}
        for request, started, ts, content in rows:
            if ts is not None:
                at = int((ts - NOON).total_seconds())
                parts.setdefault(request, []).append((started, at if content else None, at, len((content or "").split())))
        for request, facts in parts.items():
            end = max(f[2] for f in facts)
            gone = clock is not None and end + gap <= clock
            if request not in alive and (gone or (request in marks and end <= marks[request] + gap)):
                out.append((request, "late", facts))
            else:
                alive.setdefault(request, []).extend(facts)
        newest = max(f[2] for facts in parts.values() for f in facts) - hour
        clock = newest if clock is None else max(clock, newest)
        for request, facts in list(alive.items()):
            end = max(f[2] for f in facts)
            if end + gap <= clock:
                marks[request] = end
                out.append((request, "closed", alive.pop(request)))
    out += [(request, "open", facts) for request, facts in alive.items()]

    def when(seconds):
        return None if not seconds else NOON + timedelta(seconds=min(seconds))

    return sorted(
        (
            (
                request,
                outcome,
                min((f[0] for f in facts if f[0]), default=None),
                when([f[1] for f in facts if f[1] is not None]),
                NOON + timedelta(seconds=max(f[2] for f in facts)),
                sum(f[3] for f in facts),
            )
            for request, outcome, facts in out
        ),
        key=str,
    )


def test_requests_of_a_group_are_one_state_value(spark, tmp_path):
    rng, arrivals, root = random.Random(3), [], str(tmp_path)
    ids = [None, "", *(f"r{i}" for i in range(600))]
    # Where doubles hold no single microseconds.
    starts = [None, NOON, datetime(9999, 12, 31, 23, 59, 59, 999_999)]
    for low, high in ((0, 10), (2, 14), (3, 30), (8, 31)):
        hours = (None if rng.random() < 0.02 else rng.randrange(4 * low, 4 * high + 1) / 4 for _ in range(1000))
        texts = ("", None, "one", "two words")
        arrivals.append([(rng.choice(ids), rng.choice(starts), *chunk("", h, rng.choice(texts))[2:]) for h in hours])
        spark.createDataFrame(arrivals[-1], CHUNKS).write.parquet(f"{root}/in/arrival={len(arrivals)}")
        arriving = spark.readStream.schema(CHUNKS).parquet(f"{root}/in/arrival=*")
        stream = requests.stream_requests(arriving, "1 hour", timedelta(hours=4), groups=3)
        query = requests.append_requests(stream, f"{root}/out", f"{root}/log")
        query.awaitTermination()
        # A value and a timer, kept under two keys, for a group: not for each of the requests.
        operators = [op for p in query.recentProgress for op in p.stateOperators]
        assert max(op.numRowsTotal for op in operators) <= 9
        assert max(op.numRowsUpdated for op in operators) <= 9

    parts = requests.written_requests(spark, f"{root}/out").unionByName(requests.open_requests(spark, f"{root}/log"))
    times = [F.timestamp_micros(c).alias(c) for c in ("started_at", "first_ts", "end_ts")]
    got = sorted(map(tuple, parts.select("request_id", "outcome", *times, "total_tokens").collect()), key=str)
    assert got == judged(arrivals)
    assert {outcome for _, outcome, *_ in got} == {"closed", "late", "open"}

"""Streams whose state outlives their batches."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from claimweave.operators import jobs
from claimweave.streaming import ingest

FETCHED = "id int, url string, hash string, at int"


def ran(df, name, mode, checkpoint):
    df.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_changes_are_those_of_the_whole_table(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/cp-out"
    batches = [[(1, "u", "h1", 1), (2, "u", "h2", 2), (3, "v", "h1", 3)], [(4, "u", "h1", 4), (5, "v", "h9", 5), (6, "v", "h9", 6)], [(7, "w", "h1", 7), (8, "u", "h3", 8)]]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, FETCHED).coalesce(1).write.mode("append").parquet(src)
        seen += batch
        ran(ingest.detect_changes(spark.readStream.schema(FETCHED).parquet(src)), "changes", "append", f"{tmp_path}/cp")
        whole = jobs.document_versions(spark.createDataFrame(seen, FETCHED))
        assert {tuple(r) for r in spark.read.parquet(out).select("id", "url", "hash", "outcome", "version").collect()} == {tuple(r) for r in whole.collect()}


def test_a_batch_of_changes_reads_no_stored_rows(spark, tmp_path):
    """The last of many batches takes in what it brings alone."""
    src = f"{tmp_path}/in"
    for n in range(4):
        spark.createDataFrame([(n * 10 + i, f"u{i}", f"h{n}", n) for i in range(5)], FETCHED).coalesce(1).write.mode("append").parquet(src)
        query = ingest.detect_changes(spark.readStream.schema(FETCHED).parquet(src)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == 5


def test_paced_stream(spark, tmp_path):
    rows = [("h", i, 1000 * i) for i in range(5)] + [("g", 9, 50)]
    spark.createDataFrame(rows, "host string, id long, at_ms long").coalesce(1).write.parquet(f"{tmp_path}/r")
    source = spark.readStream.schema("host string, id long, at_ms long").parquet(f"{tmp_path}/r")
    expected = {tuple(r) for r in jobs.host_slots(spark.read.parquet(f"{tmp_path}/r")).collect()}
    ingest.paced(source, ttl_ms=0).writeStream.format("memory").queryName("paced").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("paced").collect()} == expected
    # With a time to live the stream goes on, and a host that was quiet for long starts anew.
    query = ingest.paced(source, ttl_ms=2000).writeStream.format("memory").queryName("forgetful").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        assert set(waited(lambda: [tuple(r) for r in spark.table("forgetful").collect()], 6)) == expected
        time.sleep(4)
        spark.createDataFrame([("h", 77, 10)], "host string, id long, at_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
        assert ("h", 77, 10, 10) in waited(lambda: [tuple(r) for r in spark.table("forgetful").collect()], 7)
    finally:
        query.stop()


def waited(rows, n, seconds=40):
    """``rows()`` once there are ``n``, or after some time."""
    end = time.time() + seconds
    while len(rows()) < n and time.time() < end:
        time.sleep(0.3)
    return rows()


EVENTS = "id int, event string, at timestamp, max_attempts int"


@pytest.fixture
def clocked(spark, tmp_path):
    """A running stream of job events: ``send`` adds events, ``told`` waits for what is told of jobs."""
    src = f"{tmp_path}/events"
    spark.createDataFrame([], EVENTS).write.parquet(src)
    query = ingest.due(spark.readStream.schema(EVENTS).parquet(src)).writeStream.format("memory").queryName("clocked").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()

    def send(*events):
        spark.createDataFrame([(i, e, at, most) for i, e, at, most in events], EVENTS).coalesce(1).write.mode("append").parquet(src)

    def told(n):
        return waited(lambda: [(r.id, r.told, r.attempts) for r in spark.table("clocked").collect()], n)

    yield send, told
    query.stop()


def now(seconds=0.0):
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(seconds=seconds)


def test_jobs_fire_when_due(clocked):
    """Ten jobs due at once are all told; one that comes early waits for its time; a failed one comes again, and ends after its last attempt."""
    send, told = clocked
    send(*[(i, "schedule", now(-60), 2 if i == 2 else 3) for i in range(10)], (90, "schedule", now(15), 3), (91, "schedule", now(3600), 3))
    first = told(10)
    assert sorted(first) == [(i, "DUE", 0) for i in range(10)]
    # Its backoff of a minute is over: the attempt was long ago.  The second failure of two is the last.
    send((1, "fail", now(-120), 3), (2, "fail", now(-300), 2), (3, "done", now(), 3))
    second = told(13)
    assert sorted(second[10:])[:2] == [(1, "DUE", 1), (2, "DUE", 1)] and (3, "DONE", 1) in second
    send((2, "fail", now(-1), 2), (91, "schedule", now(-5), 3))
    rest = told(16)
    assert {(2, "FAILED", 2), (91, "DUE", 0), (90, "DUE", 0)} <= set(rest) and len(rest) == 16
    assert rest.index((90, "DUE", 0)) >= 10


def test_a_failure_waits_for_its_backoff(clocked):
    send, told = clocked
    send((1, "schedule", now(-5), 3))
    assert told(1) == [(1, "DUE", 0)]
    send((1, "fail", now(-50), 3), (2, "schedule", now(-1), 1))
    assert told(2)[1] == (2, "DUE", 0)
    assert told(3)[2] == (1, "DUE", 1)


def test_updated_events_window(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'b'").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/e")
    ingest.counts_by_window(events).writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("counted").select("event_type", F.col("n")).collect()} == {("a", 2), ("b", 1)}

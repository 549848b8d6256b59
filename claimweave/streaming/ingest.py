"""Structured Streaming forms of candidate de-duplication, change detection, host pacing, retries and polling.

What a key has to remember between batches is state of its own, in RocksDB, with timers or a time to live; no batch reads what
earlier batches wrote.  Streams with timers or a time to live go on while they wait: they need a trigger by time, since one that ends
with the data at hand never ends.  Times are in UTC, as the session's time zone must be.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HOUR = 3_600_000


def _stateful(df: DataFrame) -> DataFrame:
    """``df``, in a session whose state store can hold several states of a key, timers and times to live."""
    conf = df.sparkSession.conf
    if "RocksDB" not in (conf.get(_PROVIDER, "") or ""):
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def new_candidates(found: DataFrame, within: str = "1 day") -> DataFrame:
    """First sight of each (source_id, canonical_url); state is dropped after ``within``."""
    return found.withWatermark("at", within).dropDuplicatesWithinWatermark(["source_id", "canonical_url"])


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


class _Versions(StatefulProcessor):
    """A url's known hashes, each with a time to live, and the number of its versions."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "hash string", "seen boolean", self.ttl)
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        made = self.version.get()[0] if self.version.exists() else 0
        began = made
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            known = self.hashes.containsKey((row.hash,))
            made += not known
            # A known hash is put again, so that what still occurs stays known.
            self.hashes.updateValue((row.hash,), (True,))
            out.append((row.id, key[0], row.hash, "UNCHANGED" if known else "CREATED" if made == 1 else "CREATED_NEW_VERSION", made))
        if made != began:
            self.version.update((made,))
        yield pd.DataFrame(out, columns=["id", "url", "hash", "outcome", "version"])

    def close(self) -> None:
        pass


def detect_changes(fetched: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """(id, url, hash, outcome, version) of streamed fetches (id, url, hash, at), as ``document_versions`` says of a whole table.

    A url's hashes and version number are its state: a batch costs what it brings, however much came before.  A hash that was not seen
    for ``ttl_ms`` (0: never) is forgotten, and is a new version if it comes again.  Inside a batch fetches go by time and id.
    """
    out = f"id {_kind(fetched, 'id')}, url {_kind(fetched, 'url')}, hash string, outcome string, version long"
    return _stateful(fetched).groupBy("url").transformWithStateInPandas(_Versions(ttl_ms), out, "append", "processingTime" if ttl_ms else "none")


class _Slots(StatefulProcessor):
    """A host's next free slot, forgotten some time after its last request."""

    def __init__(self, gap: int, ttl: int):
        self.gap, self.ttl = gap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", "at long", self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        free = self.free.get()[0] if self.free.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        starts = []
        for at in batch["at_ms"]:
            free = max(int(at), free)
            starts.append(free)
            free += self.gap
        self.free.update((free,))
        yield pd.DataFrame({"host": key[0], "id": batch["id"], "at_ms": batch["at_ms"], "start_ms": starts})

    def close(self) -> None:
        pass


def paced(requests: DataFrame, per_minute: int = 10, ttl_ms: int = HOUR) -> DataFrame:
    """(host, id, at_ms, start_ms) of streamed requests (host, id, at_ms): a host's next free slot is its state, for ``ttl_ms`` after it was used (0: for ever).

    Inside a batch requests go by time and id; ``host_slots`` is the form for a whole table.
    """
    out = f"host {_kind(requests, 'host')}, id {_kind(requests, 'id')}, at_ms long, start_ms long"
    return _stateful(requests).groupBy("host").transformWithStateInPandas(_Slots(60_000 // per_minute, ttl_ms), out, "update", "processingTime" if ttl_ms else "none")


def _millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class _Jobs(StatefulProcessor):
    """A job's attempts and the time it waits for; a timer wakes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempts int, max_attempts int, run_at long")

    def _wait(self, attempts: int, most: int, run_at: int) -> None:
        if self.job.exists() and self.job.get()[2] >= 0:
            self.handle.deleteTimer(self.job.get()[2])
        self.job.update((attempts, most, run_at))
        self.handle.registerTimer(run_at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            attempts, most, _ = self.job.get() if self.job.exists() else (0, int(row.max_attempts), -1)
            if row.event == "schedule":
                self._wait(attempts, most, _millis(row.at))
            elif row.event == "fail":
                attempts += 1
                if attempts < most:
                    self._wait(attempts, most, _millis(row.at) + 60_000 * min(60, 2 ** min(attempts - 1, 6)))
                else:
                    self._end()
                    out.append((key[0], "FAILED", attempts, None))
            elif row.event == "done":
                self._end()
                out.append((key[0], "DONE", attempts + 1, None))
        yield pd.DataFrame(out, columns=["id", "told", "attempts", "run_at"])

    def _end(self) -> None:
        if self.job.exists():
            if self.job.get()[2] >= 0:
                self.handle.deleteTimer(self.job.get()[2])
            self.job.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        attempts, most, run_at = self.job.get() if self.job.exists() else (0, 0, -1)
        if run_at == due:
            # The job stays, so that its failure counts on; it no longer waits.
            self.job.update((attempts, most, -1))
            yield pd.DataFrame([(key[0], "DUE", attempts, pd.Timestamp(due, unit="ms"))], columns=["id", "told", "attempts", "run_at"])

    def close(self) -> None:
        pass


def due(events: DataFrame) -> DataFrame:
    """(id, told, attempts, run_at) of streamed events of jobs (id, event: schedule, fail or done; at, max_attempts): what is DUE, FAILED or DONE.

    A scheduled job waits in its state, however many batches go by, and is told DUE once a processing-time timer says so; all that are due
    at a time are told.  A failed one waits for its backoff, doubling from a minute to an hour, and after the last attempt is told
    FAILED and forgotten; so is one that is done.  A job that is scheduled anew waits for the new time alone.
    """
    out = f"id {_kind(events, 'id')}, told string, attempts int, run_at timestamp"
    return _stateful(events).groupBy("id").transformWithStateInPandas(_Jobs(), out, "append", "processingTime")

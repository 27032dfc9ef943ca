"""A request limiter that makes requests wait, as a stateful stream.

A client's requests are taken one after another, by time and id. Each waits
until fewer than per_minute of its earlier ones lie within 60 s and fewer than
burst within 10 s (waiting ends when the oldest of those leaves its window, and
the check starts again), then until the wait after errors is over, and is
released. It counts at the time when it passed the first two checks. The wait
after a run of e counted errors (429 and 5xx) is 2**e seconds, at most 30,
since the last error of any kind; a success ends the run.

release() is the rule for one request: it looks at two of the remembered times
only, however long the windows are. limited() holds requests in a queue until
the watermark has passed them, so that they come in order across batches, and
again until it has passed their release; timers do both. A client whose last
minute has passed leaves no state, unless a run of errors is open.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
MINUTE, BURST = 60 * SECOND, 10 * SECOND
MOST_WAIT = 30


@dataclass
class Client:
    """What has to be remembered of a client's past, in microseconds."""

    times: deque[int] = field(default_factory=deque)  # the last requests', as many as the larger limit
    clock: int = 0  # the last release
    errors: int = 0
    failed: int = 0  # the last error

    def release(self, ts: int, ok: bool, status: int, per_minute: int, burst: int) -> int:
        """When a request of time ts is released; its answer is counted."""
        now = max(ts, self.clock)
        if len(self.times) >= per_minute:
            now = max(now, self.times[-per_minute] + MINUTE)
        if len(self.times) >= burst:
            now = max(now, self.times[-burst] + BURST)
        self.times.append(now)
        if len(self.times) > max(per_minute, burst):
            self.times.popleft()
        self.clock = max(now, self.failed + min(2**self.errors, MOST_WAIT) * SECOND) if self.errors else now
        if ok:
            self.errors = 0
        else:
            self.failed = self.clock
            self.errors += status == 429 or status >= 500
        return self.clock

    def quiet_from(self) -> int:
        """From when on the times remembered matter to no request."""
        return max(self.clock, (self.times[-1] if self.times else 0) + MINUTE)


class Limiter(StatefulProcessor):
    def __init__(self, per_minute: int, burst: int) -> None:
        self.per_minute, self.burst = per_minute, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "times array<bigint>, clock bigint, errors int, failed bigint")
        self.waiting = handle.getListState("waiting", "ts bigint, id bigint, ok boolean, status int")
        self.released = handle.getListState("released", "ts bigint, id bigint, at bigint")

    def _client(self) -> Client:
        if not self.past.exists():
            return Client()
        times, clock, errors, failed = self.past.get()
        return Client(deque(times), clock, errors, failed)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))  # the first millisecond that isn't before it

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        come = [(int(r.ts.value // 1000), int(r.id), bool(r.ok), int(r.status)) for part in rows for r in part.itertuples(index=False)]
        self.waiting.appendList(come)
        self._wake(min(come)[0])
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Takes all that the watermark has passed, and sets the next timer: one for each list, not for each request."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        queue = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        held = [tuple(r) for r in self.released.get()] if self.released.exists() else []
        due, later = [r for r in queue if r[0] <= mark], [r for r in queue if r[0] > mark]
        client = self._client()
        held += [(ts, id_, client.release(ts, ok, status, self.per_minute, self.burst)) for ts, id_, ok, status in due]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        gone = [r for r in held if r[2] <= mark]
        kept = [r for r in held if r[2] > mark]
        self.released.put(kept) if kept else self.released.clear()
        if later:
            self._wake(later[0][0])
        if kept:
            self._wake(min(r[2] for r in kept))
        if not later and not kept and not client.errors and client.quiet_from() <= mark:
            self.past.clear()
        else:
            self.past.update((list(client.times), client.clock, client.errors, client.failed))
            if client.quiet_from() > mark:
                self._wake(client.quiet_from())
        if gone:
            made = pd.DataFrame(gone, columns=["ts", "id", "released_at"])
            made["client"] = key[0]
            for c in ("ts", "released_at"):
                made[c] = pd.to_datetime(made[c], unit="us")
            yield made[["client", "id", "ts", "released_at"]]

    def close(self) -> None:
        pass


def limited(requests: DataFrame, per_minute: int = 60, burst: int = 10, late: str = "10 seconds") -> DataFrame:
    """A stream of client, id, ts, ok, status: client, id, ts and released_at of
    each request, once the watermark (the latest ts less `late`) has passed its
    release. Requests at or before the watermark are dropped, as streams have it;
    late has to cover how far they come out of order. Start it under state_store()."""
    client = requests.schema["client"].dataType.simpleString()
    rows = requests.select("client", "id", "ts", "ok", "status").withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(
        Limiter(per_minute, burst), f"client {client}, id bigint, ts timestamp, released_at timestamp", "Append", "EventTime"
    )


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started meanwhile keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)

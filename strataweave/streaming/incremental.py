"""Streams: incremental upserts of chunks, and request throttling."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from strataweave.functions.text import chunk
from strataweave.operators.chunk_store import ChunkStore
from strataweave.operators.store import latest

CHUNKS = "url string, chunk_number int, content string"


def stream_upserts(documents: DataFrame, store: ChunkStore, checkpoint: str, size: int = 5000, order: str | None = None, replace: bool = True, compact_after: int = 32) -> StreamingQuery:
    """documents (a stream of url, text) into a store of chunks; of a URL the last text stands.

    Within a batch that is the one of the highest order (a column; of equal or no
    orders, the one that comes last), whatever its length, and batches follow one
    another. With replace, all earlier chunks of a batch's URLs go; without,
    chunks replace those of their number, and a shorter text leaves the longer
    one's last chunks. A batch is one commit, loaded once even if it runs again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = [*([F.col(order).desc_nulls_last()] if order else []), F.desc("_at")]
        rows = chunk(latest(batch.withColumn("_at", F.monotonically_increasing_id()), ["url"], newest), "text", size)
        version = store.load(rows, deletes=batch.select("url") if replace else None, stream=(checkpoint, number))
        if len(version.batches) >= compact_after:
            store.compact()
            store.forget()

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttle(requests: DataFrame, per_minute: int = 60, burst: int = 10) -> DataFrame:
    """A stream of client, ts, ok, status (and id, for the order of equal times):
    for each request whether it comes too soon, and the wait after errors
    (doubling, at most 30 s). State per client holds the last minute's times, in
    microseconds, and the run of errors."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, errors = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches))
        rows = rows.sort_values([c for c in ("ts", "id") if c in rows.columns])
        out = []
        for r in rows.itertuples():
            now = r.ts.value // 1000
            times = [t for t in times if now - t < 60_000_000]
            soon = sum(t < now for t in times) >= per_minute or sum(0 < now - t < 10_000_000 for t in times) >= burst
            times.append(now)
            errors = 0 if r.ok else errors + (r.status == 429 or r.status >= 500)
            out.append((key[0], r.ts, bool(soon), int(errors), float(min(2**errors, 30)) if errors else 0.0))
        state.update((times, errors))
        yield pd.DataFrame(out, columns=["client", "ts", "throttled", "errors", "backoff_s"])

    client = requests.schema["client"].dataType.simpleString()
    return requests.groupBy("client").applyInPandasWithState(
        step, f"client {client}, ts timestamp, throttled boolean, errors int, backoff_s double", "times array<bigint>, errors int", "append", GroupStateTimeout.NoTimeout
    )

"""Buffers that are dropped when nothing has read them for a while: keyed state with a timer for each key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_ttl(reads: DataFrame, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """Streaming reads(uri, ts timestamp) -> uri, micros, evicted: a row when a buffer begins to be held (micros of its first
    read) and one when it is evicted (of its last).

    A buffer goes once the watermark has passed its last read by more than ttl_ms; its state goes with it, so state is as
    large as what is held. A read after that begins anew. A read that is already too old when it comes does both at once.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def rows(*changes: tuple[int, bool]) -> pd.DataFrame:
            return pd.DataFrame({"uri": [key[0]] * len(changes), "micros": [c[0] for c in changes], "evicted": [c[1] for c in changes]})

        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield rows((last, True))
            return
        times = [int(t) for batch in batches for t in batch["micros"]]
        began: list[tuple[int, bool]] = [] if state.exists else [(min(times), False)]
        last = max(times + ([state.get[0]] if state.exists else []))
        due = last // 1000 + ttl_ms
        if due < state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield rows(*began, (last, True))
            return
        state.update((last,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if began:
            yield rows(*began)

    kind: Any = dict(reads.dtypes)["uri"]
    timed = reads.where("uri is not null and ts is not null").select("uri", "ts").withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("uri").applyInPandasWithState(run, f"uri {kind}, micros long, evicted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def evicted(changes: DataFrame) -> DataFrame:
    """What with_ttl() gave so far -> uri, last of those that are not held now."""
    newest = changes.groupBy("uri").agg(F.max(F.struct("micros", "evicted")).alias("m"))
    return newest.where("m.evicted").select("uri", F.timestamp_micros("m.micros").alias("last"))

"""Requests that wait until an index has reached the version they ask for, and are answered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.store import VersionedTable


def answer_when_ready(requests: DataFrame, version: Callable[[], int], answer: Callable[[DataFrame, int], None], waiting: VersionedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Streaming requests, with the columns of waiting, among them wants (long, the version from which on the index will do).

    A micro-batch answers what asks for no more than version() and keeps the rest in waiting; where new requests may be
    rare, union the stream with a heartbeat whose wants is null, so that batches go on. answer(requests, batch_id) must be
    keyed by the batch: one that broke off before waiting was published runs again, and may then find a later version.
    A batch that was published is not answered again. Requests without wants are dropped.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= waiting.version:
            return
        now = version()
        every = waiting.read().unionByName(batch.where("wants is not null").select(*waiting.schema.fieldNames()))
        answer(every.where(F.col("wants") <= now), batch_id)
        waiting.publish(every.where(F.col("wants") > now), batch_id)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""What long steps report while they run: beginning, counts and end of each, of batch jobs and of streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

Sink = Callable[[dict[str, Any]], None]


class Progress:
    """Gives sink one row for the beginning of a step, one for each relation that was counted in it, and one for its end.

    Counts are taken by the job that reads the relation anyway (observed metrics), so they cost no job of their own. A
    relation that is counted must be read by a job of its step, for whose counts the end of the step waits; a step that
    fails reports none.
    """

    def __init__(self, sink: Sink) -> None:
        self.sink = sink
        self._open: list[list[tuple[str, Observation]]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[Progress]:
        self.sink({"step": name, "event": "begin"})
        self._open.append([])
        began, failed = time.monotonic(), None
        try:
            yield self
        except BaseException as e:
            failed = type(e).__name__
            raise
        finally:
            for what, seen in self._open.pop():
                if failed is None:
                    self.sink({"step": name, "event": "report", "what": what, **seen.get})
            self.sink({"step": name, "event": "end", "seconds": time.monotonic() - began, "failed": failed})

    def counted(self, df: DataFrame, what: str, **measures: Column) -> DataFrame:
        """df; rows, and the aggregates asked for, are reported at the end of the step."""
        if not self._open:
            return df
        seen = Observation()
        self._open[-1].append((what, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in measures.items()))


class StreamProgress(StreamingQueryListener):
    """The same rows for streams: spark.streams.addListener(StreamProgress(sink)). Streams without a name go by their id."""

    def __init__(self, sink: Sink) -> None:
        self.sink, self.names = sink, {}

    def onQueryStarted(self, event: Any) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.sink({"step": self.names[str(event.id)], "event": "begin"})

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        self.sink({"step": p.name or str(p.id), "event": "report", "what": "batch", "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.sink({"step": self.names.get(str(event.id), str(event.id)), "event": "end", "failed": event.exception})

"""Links that are looked at again after delivery: a state with timers for each link."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE, HOUR = 60_000, 3_600_000
VISIT = "url string, attempt int, due_ms long"
#: State with timers needs this store: spark.conf.set(*STATE_STORE) before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Visits(StatefulProcessor):
    """A link is due `first_ms` after it was seen, then every `every_ms`, `attempts` times in all. A link that is being watched isn't watched
    twice; after its last visit it is forgotten, or `keep_ms` after its state was last written, whatever became of its timer."""

    def __init__(self, first_ms: int, every_ms: int, attempts: int, keep_ms: int) -> None:
        self.first_ms, self.every_ms, self.attempts, self.keep_ms = first_ms, every_ms, attempts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "n int", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        for _ in rows:
            pass
        if not self.made.exists():
            self.made.update((0,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.first_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.made.exists():
            n = self.made.get()[0] + 1
            if n < self.attempts:
                self.made.update((n,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
            else:
                self.made.clear()
            yield pd.DataFrame({"url": [key[0]], "attempt": [n], "due_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def link_visits(links: DataFrame, first_ms: int = 30 * MINUTE, every_ms: int = 6 * HOUR, attempts: int = 4, keep_ms: int = 72 * HOUR) -> DataFrame:
    """A stream of links (url) -> a stream of visits (url, attempt, due_ms) as they fall due, by processing time. What a sink takes of them at
    once is bounded there (ingest.due_visits over a table of watches)."""
    watched = links.select("url").where("url is not null").groupBy("url")
    return watched.transformWithStateInPandas(statefulProcessor=Visits(first_ms, every_ms, attempts, keep_ms), outputStructType=VISIT, outputMode="Update", timeMode="ProcessingTime")

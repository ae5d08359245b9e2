"""Counters of running streams, from Spark's own progress reports."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

# Upper bounds of the buckets of batch durations, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1, 5, 10, 60)


class Metrics(StreamingQueryListener):
    """Batches, records in, failures and durations by query name (or id, where it has none), since this was added to a session."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.counts: dict[tuple[str, str], int] = defaultdict(int)
        self.names: dict[str, str] = {}

    def add_to(self, spark: SparkSession) -> Metrics:
        spark.streams.addListener(self)
        return self

    def count(self, name: str, what: str, n: int = 1) -> None:
        with self.lock:
            self.counts[name, what] += n

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.count(event.name or str(event.id), "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        seconds = p.batchDuration / 1000
        self.count(name, "batches")
        self.count(name, "records", p.numInputRows)
        self.count(name, "milliseconds", p.batchDuration)
        for b in BUCKETS:
            if seconds <= b:
                self.count(name, f"batches_within_{b}s")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.get(str(event.id), str(event.id))
        self.count(name, "failed" if event.exception else "ended")

    def text(self) -> str:
        """One line a counter: query, name, value."""
        with self.lock:
            return "\n".join(f'tidelog_{what}{{query="{name}"}} {n}' for (name, what), n in sorted(self.counts.items()))

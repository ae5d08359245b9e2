"""Live tail: records that match, as they come, without duplicates and in order, within a window."""

from __future__ import annotations

import contextlib
import datetime as dt
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidelog.functions import ulid as U
from tidelog.operators.search import LogQuery, matches
from tidelog.sources import files

# Where state is kept; timers need the first, and Spark's default is the second.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_starting = threading.Lock()


@contextlib.contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB where the session has Spark's default, which knows no timers. A stream
    takes its settings when it starts, so the session's own is put back after it; a stream that is started again stays with what its
    checkpoint names."""
    with _starting:
        before = spark.conf.get(PROVIDER)
        if before != DEFAULT_STATE:
            yield
            return
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            yield
        finally:
            spark.conf.set(PROVIDER, before)


def window_of(text: str | None) -> dt.timedelta:
    """The window of a tail: three seconds if it can't be read, a tenth of a second at least."""
    try:
        w = U.parse_duration(text or "")
    except ValueError:
        w = dt.timedelta(seconds=3)
    return max(w, dt.timedelta(milliseconds=100))


_HELD = pa.schema([("ulid", pa.string()), ("body", pa.string()), ("arrival", pa.int64()), ("due", pa.int64())])


def last_of(lines: pa.Table) -> pa.Table:
    """The last line of each identifier: the highest arrival, of equal ones the later row."""
    n = len(lines)
    order = np.lexsort((np.arange(n), lines["arrival"].to_numpy()))
    at = lines["ulid"].take(pa.array(order)).combine_chunks().dictionary_encode()
    last = np.zeros(len(at.dictionary), np.int64)
    last[at.indices.to_numpy()] = order  # of several assignments the last counts
    return lines.take(pa.array(np.sort(last)))


class LastWins(StatefulProcessor):
    """Per shard of identifiers: holds the last line of each, and gives it out when the window has passed its time. A late line comes out again.

    All of a shard's lines are one value of state, an Arrow table, and one timer stands for the first that is due: the cost is one state
    access a shard and batch, not one an identifier.
    """

    def __init__(self, window_ms: int, event_time: bool):
        self.window_ms, self.event_time = window_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", "held binary, timer bigint")

    def held(self) -> tuple[pa.Table, int | None]:
        if not self.lines.exists():
            return _HELD.empty_table(), None
        held, timer = self.lines.get()
        return pa.ipc.open_stream(bytes(held)).read_all(), timer

    def keep(self, lines: pa.Table, timer: int | None, now: int) -> None:
        if not len(lines):
            self.lines.clear()
            return
        due = int(pc.min(lines["due"]).as_py())
        due = due if self.event_time else max(due, now + 1)
        if timer is None or timer > due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, lines.schema) as w:
            w.write_table(lines)
        self.lines.update((sink.getvalue().to_pybytes(), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines, timer = self.held()
        for batch in rows:
            new = pa.table({"ulid": pa.array(batch["ulid"], pa.string()), "body": pa.array(batch["body"], pa.string()), "arrival": pa.array(batch["arrival"], pa.int64())})
            new = new.append_column("due", pa.array([U.decode_ms(x) + self.window_ms for x in batch["ulid"]], pa.int64()))
            lines = last_of(pa.concat_tables([lines, new]))
        self.keep(lines, timer, timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lines, _ = self.held()
        upto = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        due = pc.less_equal(lines["due"], max(upto, now))
        self.keep(lines.filter(pc.invert(due)), None, now)
        out = lines.filter(due)
        if len(out):
            yield out.select(["ulid", "body"]).to_pandas()

    def close(self) -> None:
        pass


def tail(records: DataFrame, query: LogQuery | None = None, window: str | None = "3s", event_time: bool = False, shards: int | None = None) -> DataFrame:
    """A stream of (ulid, body) from a stream of records (ulid, body, and arrival to order lines that come together).

    Of lines of one identifier within the window the last counts. By processing time (as a store's tail) a late line comes out
    again; by event time what the window has passed is dropped, which is the same on every run. Bounds of the query don't count.
    What is still held when the input ends isn't given out. shards: pieces of state (four times the shuffle partitions, if none are given).
    Start it with in_order, or inside state_with_timers.
    """
    d = records.where("ulid is not null")
    if query is not None:
        d = d.where(matches(query, F.col("body")))
    if "arrival" not in d.columns:
        d = d.withColumn("arrival", F.lit(0).cast("bigint"))
    ms = window_of(window) // dt.timedelta(milliseconds=1)
    if event_time:
        d = d.withColumn("at", U.ulid_ts(F.col("ulid"))).withWatermark("at", f"{ms} milliseconds")
        # the watermark is behind by the window already; a line that is right on it is held
        ms = 1
    n = shards or 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("shard", F.pmod(F.xxhash64("ulid"), F.lit(n)))
    return d.groupBy("shard").transformWithStateInPandas(LastWins(ms, event_time), "ulid string, body string", "Append", "EventTime" if event_time else "ProcessingTime")


def new_segments(spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """Records (ulid, body) of segments that come into a store's folder from now on, as a stream; of a tail that is started again, from
    its first start on. Files that are older are told by their time and not opened."""
    start = remembered(checkpoint, "start", lambda: int(time.time() * 1000))
    text = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", "*.flushed").text(folder)
    text = text.where(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(start))).select("value")
    return files.take_apart(text).where("not bad").select("ulid", "body")


def remembered(checkpoint: str, name: str, make: Callable[[], int]) -> int:
    """A number that is made once and kept beside a checkpoint."""
    fs, root = pafs.FileSystem.from_uri(checkpoint)
    path = f"{root}/kept/{name}"
    if fs.get_file_info(path).type == pafs.FileType.File:
        with fs.open_input_stream(path) as f:
            return int(f.read())
    made = make()
    fs.create_dir(f"{root}/kept", recursive=True)
    with fs.open_output_stream(f"{path}.tmp") as f:
        f.write(str(made).encode())
    fs.move(f"{path}.tmp", path)
    return made


def in_order(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream whose batches go to sink(batch, number), each in order of identifier. A tail runs on any session, as its state has timers."""
    with state_with_timers(stream.sparkSession):
        return stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).foreachBatch(lambda d, n: sink(d.orderBy("ulid"), n)).start()


def distinct_stream(records: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """The first line of each identifier, by Spark's own operator: for streams where copies are the same."""
    return records.withColumn("at", U.ulid_ts(F.col("ulid"))).withWatermark("at", delay).dropDuplicatesWithinWatermark(["ulid"]).drop("at")


class Registry:
    """Live queries by name: each record goes to every query that it matches. One pass over the stream for all of them."""

    def __init__(self) -> None:
        self.queries: dict[str, LogQuery] = {}
        self.closing = False

    def register(self, name: str, query: LogQuery) -> None:
        if self.closing:
            raise RuntimeError("no new queries: closing")
        self.queries[name] = query

    def deregister(self, name: str) -> None:
        self.queries.pop(name, None)

    def close(self) -> None:
        self.closing = True
        self.queries.clear()

    def match(self, records: DataFrame) -> DataFrame:
        """query, and the columns of each record that it matches; works on a stream or a batch."""
        if not self.queries:
            return records.where("false").select(F.lit("").alias("query"), "*")
        hits = F.filter(F.array(*[F.when(matches(q, F.col("body")), F.lit(n)) for n, q in self.queries.items()]), lambda x: x.isNotNull())
        return records.select(F.explode(hits).alias("query"), "*")

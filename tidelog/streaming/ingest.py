"""Streams of lines into a store's folder: topics, identifiers, segments; rows that can't be taken are set apart."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import dedup, ingest
from tidelog.operators.store import LogStore
from tidelog.streaming.tail import remembered

# When a segment is flushed.
FLUSH_SIZE = 16 << 20
FLUSH_AGE = "3 seconds"


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a TCP server; for trials, as the source can't be read again."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_lines(spark: SparkSession, folder: str, most_files: int = 1) -> DataFrame:
    """Lines of files as they appear, oldest first."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", most_files).option("latestFirst", False).text(folder)


def ingest_lines(lines: DataFrame, store: LogStore, checkpoint: str, rejected: str, topic: str | None = None, flush_size: int = FLUSH_SIZE, now_ms=None, mode: str = "fast", **trigger) -> StreamingQuery:
    """Write lines (value) into a store. topic: that of all lines, or None where each line has its own; bad lines go to `rejected`.

    A batch that is run again after a failure writes the same identifiers (time and entropy come from the checkpointed batch), and
    readers and compaction drop what is there twice. mode 'fast': a batch every FLUSH_AGE; 'durable': one as soon as there are lines, and on
    disk before its offsets are committed. now_ms: a function of the batch's number, for tests.
    """
    if mode not in ("fast", "durable"):
        raise ValueError(mode)

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if topic is None:
                good, bad = ingest.dynamic_topics(batch)
                bad.select("value", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{rejected}/batch={number:08d}")
            else:
                good = ingest.static_topic(batch, topic)
            at = now_ms(number) if now_ms else remembered(checkpoint, f"time-{number:08d}", lambda: int(time.time() * 1000))
            store.append(ingest.with_ids(good, number, at), flush_size, durable=mode == "durable")
        finally:
            batch.unpersist()

    trigger = trigger or {"processingTime": FLUSH_AGE if mode == "fast" else "0 seconds"}
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(take).start()


def deduplicated(messages: DataFrame, index: dedup.DedupIndex, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of deliveries (row_id, src, ulid, ...) with each batch's superseded rows written to out/batch=N, by one index."""

    def take(batch: DataFrame, number: int) -> None:
        index.add(batch, number).select("row_id").write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return messages.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FLUSH_AGE})).foreachBatch(take).start()

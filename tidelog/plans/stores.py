"""Queries that run a store of real segment files end to end: written, read, compacted, recovered, trashed."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ulid as U
from tidelog.functions.scale import shared_dir, written
from tidelog.operators import search
from tidelog.operators.search import LogQuery
from tidelog.operators.store import LogStore
from tidelog.plans.logs import FROM, OLDEST_MS, REC, TO
from tidelog.sources import files
from tidelog.sources.tables import event_records

ALL = LogQuery("1970-01-01T00:00:00Z", "9999-12-31T00:00:00Z")
SEGMENT_BYTES = 64 << 10
_LO, _HI = U.encode_ms(U.decode_ms(U.low_of(FROM))), U.encode_ms(U.decode_ms(U.low_of(TO)))


def filled(spark: SparkSession, folder: str) -> LogStore:
    """A store of all events, from three connections whose segments overlap; a fifth of the records came over two of them."""
    store = LogStore(spark, shared_dir(spark, "store"))
    r = written(event_records(spark, folder).select("ulid", "raw", "event_id"), "records")  # else made for each connection, and again for its order
    for k in range(3):
        store.append(r.where((F.col("event_id") % 3 == k) | (F.col("event_id") % 15 == k)), SEGMENT_BYTES)
    return store


def store_write_read(spark: SparkSession, folder: str) -> DataFrame:
    return filled(spark, folder).query(LogQuery(FROM, TO, "error")).select("ulid", "body")


def store_stats_only(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the statistics of a range, from names alone, are those of the files that a scan of the range reads."""
    store = filled(spark, folder)
    read = files.read(spark, store.folder, U.low_of(FROM), U.high_of(TO)).select("segment", "segment_bytes").distinct()
    r = read.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("segment_bytes"), F.lit(0)).alias("size")).first()
    # a segment may have the range's neighbours only, and then gives the scan no record
    return store.stats(LogQuery(FROM, TO)).select((F.col("segments_queried") >= r.n).alias("all_files"), (F.col("max_data_set_size") >= r["size"]).alias("all_bytes"))


def store_compact(spark: SparkSession, folder: str) -> DataFrame:
    """How often each record is in the files after turns of compaction until nothing overlaps: once. A turn takes all that overlaps."""
    store = filled(spark, folder)
    while store.compact_overlapping(SEGMENT_BYTES):
        pass
    return files.read(spark, store.folder).groupBy("ulid").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))


def store_recover(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a store in which a third of the segments were being written, and a third being compacted, when it crashed."""
    store = filled(spark, folder)
    left = written(store.index().select("path", (F.crc32("path") % 3).alias("n")), "crash")

    def crash(state: str):
        def act(fs: pafs.FileSystem, path: str) -> bool:
            head, _, name = path.rpartition("/")
            fs.move(path, f"{head}/7-{name[:26]}-{name[27:53]}.active" if state == "active" else f"{path.rpartition('.')[0]}.{state}")
            return True

        return act

    files.per_file(left.where("n = 0"), store.folder, crash("active"))
    files.per_file(left.where("n = 1"), store.folder, crash("reading"))
    store.recover()
    return store.query(ALL).select("ulid", "body")


def store_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Records before a time that are left when the segments which end before it were trashed and purged: those of segments that go on."""
    store = filled(spark, folder)
    store.trash(OLDEST_MS + 7 * 86_400_000)
    before = store.query(ALL).where(U.ulid_ms(F.col("ulid")) >= OLDEST_MS).select("ulid")
    store.purge(OLDEST_MS + 30 * 86_400_000)
    return before


def store_accounted(spark: SparkSession, folder: str) -> DataFrame:
    """Low, high, records and bytes of what is read, observed while it is written elsewhere."""
    d, seen = search.accounted(filled(spark, folder).query(ALL))
    d.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "low string, high string, n_records bigint, n_bytes bigint")


QUERIES = {f.__name__: f for f in (store_write_read, store_stats_only, store_compact, store_recover, store_retention, store_accounted)}
SQL = {
    "store_write_read": f"with {REC} select ulid, body from rec where substr(ulid, 1, 10) between '{_LO}' and '{_HI}' and contains(body, 'error')",
    "store_stats_only": "select true as all_files, true as all_bytes",
    "store_compact": f"with {REC} select ulid, 1::bigint as n, 0::bigint as n_bad from rec",
    "store_recover": f"with {REC} select ulid, body from rec",
    "store_retention": f"with {REC} select ulid from rec where ms >= {OLDEST_MS}",
    "store_accounted": f"with {REC} select min(ulid) as low, max(ulid) as high, count(*) as n_records, sum(strlen(ulid) + strlen(body) + 2)::bigint as n_bytes from rec",
}

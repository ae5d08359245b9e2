"""A folder of segments: queries, compaction, retention and recovery, by changes of state that are single renames."""

from __future__ import annotations

import time

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ulid as U
from tidelog.functions.scale import spread, written
from tidelog.operators import search, segments
from tidelog.operators.search import LogQuery
from tidelog.sources import files

# Defaults of a store.
TARGET_SIZE = 128 << 20
RETAIN_MS = 7 * 86_400_000
PURGE_MS = 86_400_000


class LogStore:
    """One writer at a time keeps a folder; any number read it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self._turn = 0

    # --- reading ---

    def index(self) -> DataFrame:
        return files.listing(self.spark, self.folder).where("low is not null")

    def quarantined(self) -> DataFrame:
        """Files whose names are no segments (nor those of files being written); a read leaves them alone."""
        return files.listing(self.spark, self.folder).where("low is null and not endswith(path, '.active')").select("path", "size_bytes")

    def query(self, q: LogQuery, extra: Column | None = None) -> DataFrame:
        """Matching records in order, without duplicates, whichever segments hold them."""
        if q.start is None or q.stop is None:
            raise ValueError("a query needs both bounds")
        d = files.read(self.spark, self.folder, U.low_of(q.start), U.high_of(q.stop)).where("not bad")
        # of copies in several segments the one of the first name counts
        return search.run(d.withColumn("src", F.col("segment")).drop("segment", "segment_bytes", "bad"), q, extra=extra)

    def stats(self, q: LogQuery) -> DataFrame:
        return search.stats(self.index().where(F.col("state").isin(*segments.QUERYABLE)), q)

    def state_stats(self) -> DataFrame:
        return segments.state_stats(self.index())

    def view(self, name: str = "logs") -> None:
        """The records as a view for SQL."""
        files.read(self.spark, self.folder).where("not bad").select("ulid", "ts_ms", "topic", "payload", "body", "raw", "segment").createOrReplaceTempView(name)

    # --- writing ---

    def append(self, records: DataFrame, target: int = TARGET_SIZE, durable: bool = False, starts: list[str] | None = None) -> int:
        """Write records (ulid, raw, and perhaps src) as new segments; how many segments. Nothing that is there is lost: see files.put_in_place."""
        return written(files.write(records, self.folder, target, durable=durable, starts=starts), "segments").count()

    def _rename(self, path: str, state: str) -> str:
        to = f"{path.rpartition('.')[0]}.{state}"
        files.put_in_place(self.fs, path, to)
        return to

    # --- one consumer at a time takes segments on, oldest first ---

    def claim(self) -> str | None:
        """Claim the flushed segment that was written first: it is `pending`, and not queried, until commit() or release(). None: there is none."""
        top = self.index().where("state = 'flushed'").agg(F.min_by("path", F.struct("mtime_ms", "path")).alias("path")).first().path
        return top and self._rename(top, "pending")

    def commit(self, path: str) -> None:
        """What was claimed has been taken over elsewhere: it goes."""
        self.fs.delete_file(path)

    def release(self, path: str) -> str:
        """What was claimed could not be taken over: it is flushed again."""
        return self._rename(path, "flushed")

    def compact(self, paths: list[str], target: int = TARGET_SIZE) -> int:
        """Merge segments into as many as their size needs; inputs go when the outputs are complete, and come back if it fails.

        An input is `reading`, and so still queried, until then; readers drop what is there twice.
        """
        if not paths:
            return 0
        claimed = [self._rename(p, "reading") for p in paths]
        try:
            d = files.take_apart(self.spark.read.option("lineSep", "\n").text([self._uri(p) for p in claimed]).select("value", F.col("_metadata.file_name").alias("src")))
            merged = search.first_source(d.where("not bad").select("ulid", "src", "raw"))
            n = self.append(merged, target)
        except BaseException:
            for p in claimed:
                self._rename(p, "flushed")
            raise
        for p in claimed:
            # an output of the same range has taken the name of a flushed one, not of this
            self.fs.delete_file(p)
        return n

    def compact_overlapping(self, target: int = TARGET_SIZE, least: int = 2) -> int:
        """Merge each island of `least` or more flushed segments, all in one turn; how many segments were written. None overlap then.

        It takes a number of jobs that doesn't grow with the segments, and writes each record once, where overlapping() and compact() take
        a turn for every few segments. No output goes beyond its island. Inputs are treated as in compact(), by tasks.
        """
        picked = written(segments.overlapping_islands(self.index().where("state = 'flushed'"), least).select("path", "low", "island"), "overlapping")
        starts = [r.low for r in picked.groupBy("island").agg(F.min("low").alias("low")).orderBy("low").collect()]
        if not starts:
            return 0
        claimed = picked.select(F.regexp_replace("path", "\\.[^.]*$", ".reading").alias("path"))

        def rename(state: str):
            def act(fs: pafs.FileSystem, path: str) -> bool:
                files.put_in_place(fs, path, f"{path.rpartition('.')[0]}.{state}")
                return True

            return act

        def delete(fs: pafs.FileSystem, path: str) -> bool:
            fs.delete_file(path)
            return True

        try:
            files.per_file(spread(picked), self.folder, rename("reading"))
            # the folder is listed once; thousands of paths would be, each by a task
            d = self.spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.reading").text(self.folder).select("value", F.col("_metadata.file_name").alias("src"))
            if not files.listing(self.spark, self.folder).where("endswith(path, '.reading')").join(claimed, "path", "left_anti").isEmpty():
                # a crash left others, which are not deleted below
                d = d.join(claimed.select(F.substring_index("path", "/", -1).alias("src")), "src", "left_semi")
            n = self.append(files.take_apart(d).where("not bad").select("ulid", "src", "raw"), target, starts=starts)
        except BaseException:
            files.per_file(spread(claimed), self.folder, rename("flushed"))
            raise
        files.per_file(spread(claimed), self.folder, delete)
        return n

    def _uri(self, path: str) -> str:
        return self.folder.rpartition(self.root)[0] + path

    def overlapping(self, least: int = 3) -> list[str]:
        """The flushed segment that overlaps most others, and those."""
        return [r.path for r in segments.compaction_pick(self.index().where("state = 'flushed'"), "path", least).collect()]

    def sequential(self, target: int = TARGET_SIZE, least: int = 2) -> list[str]:
        """The first flushed segments in order that are small enough to be one."""
        return [r.path for r in segments.first_sequential(self.index().where("state = 'flushed'"), "path", "size_bytes", target, least).orderBy("position").collect()]

    def trash(self, now_ms: int, retain_ms: int = RETAIN_MS) -> int:
        """Rename flushed segments that ended before now - retain to the trash, by tasks. When that was is noted first, in the table _trash."""
        old = segments.expired(self.index().where("state = 'flushed'"), max(0, now_ms - retain_ms)).select("path")
        note = f"{self.folder}/_trash/moved_ms={now_ms}"
        old.write.mode("append").parquet(note)

        def move(fs: pafs.FileSystem, path: str) -> bool:
            files.put_in_place(fs, path, f"{path.rpartition('.')[0]}.trashed")
            return True

        return files.per_file(self.spark.read.parquet(note).distinct(), self.folder, move)

    def trashed(self) -> DataFrame:
        """The segments in the trash with trashed_ms: when they were moved there; where that isn't known, when they were written."""
        d = self.index().where("state = 'trashed'").withColumn("_base", F.regexp_replace("path", "\\.[a-z]+$", ""))
        if self.fs.get_file_info(f"{self.root}/_trash").type != pafs.FileType.Directory:
            return d.withColumn("trashed_ms", F.col("mtime_ms")).drop("_base")
        notes = self.spark.read.schema("path string, moved_ms bigint").parquet(f"{self.folder}/_trash")
        notes = notes.groupBy(F.regexp_replace("path", "\\.[a-z]+$", "").alias("_base")).agg(F.max("moved_ms").alias("moved_ms"))
        return d.join(notes, "_base", "left").withColumn("trashed_ms", F.coalesce("moved_ms", "mtime_ms")).drop("_base", "moved_ms")

    def purge(self, now_ms: int, purge_ms: int = PURGE_MS) -> int:
        """Delete segments that were trashed before now - purge, by tasks; then the notes of that time."""

        def delete(fs: pafs.FileSystem, path: str) -> bool:
            fs.delete_file(path)
            return True

        n = files.per_file(segments.purgeable(self.trashed(), now_ms - purge_ms), self.folder, delete)
        for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/_trash", allow_not_found=True)):
            if f.base_name.startswith("moved_ms=") and int(f.base_name[9:]) < now_ms - purge_ms:
                self.fs.delete_dir(f.path)
        return n

    def recover(self) -> int:
        """After a crash, when nothing else runs: files that were being written get their range as name, those being compacted or taken on
        are flushed again; by tasks. How many files. Readers drop what is then there twice."""
        left = files.listing(self.spark, self.folder).where("endswith(path, '.active') or state in ('reading', 'pending')")
        return files.per_file(written(left.select("path"), "recover").repartition("path"), self.folder, files.recover_file)

    def run_once(self, now_ms: int | None = None, target: int = TARGET_SIZE) -> tuple[str, int]:
        """One turn of upkeep: overlapping, sequential, trash and purge, one after the other."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        turn = ("overlapping", "sequential", "trash", "purge")[self._turn % 4]
        self._turn += 1
        if turn == "overlapping":
            return turn, self.compact(self.overlapping(), target)
        if turn == "sequential":
            return turn, self.compact(self.sequential(target), target)
        return turn, self.trash(now_ms) if turn == "trash" else self.purge(now_ms)

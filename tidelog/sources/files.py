"""Segment files of text: <low>-<high>.<state>, one record a line, in order of identifier."""

from __future__ import annotations

import bisect
import heapq
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ulid as U
from tidelog.operators import segments

# Fixed value: the name of a segment file.
NAME = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}-[0-7][0-9A-HJKMNP-TV-Z]{25}\.[a-z]+\z"
_ULID = re.compile(U.ULID_PATTERN)


def take_apart(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines as records: ulid, ts_ms, topic, payload, body, raw, and bad (true: shorter than an identifier and a space, or no ULID)."""
    raw = F.col(line)
    d = lines.withColumn("raw", raw).withColumn("ulid", U.normal_ulid(F.substring(raw, 1, 26)))
    d = d.withColumn("bad", F.coalesce((F.length(raw) <= 26) | F.col("ulid").isNull() | (F.substring(raw, 27, 1) != " "), F.lit(True)))
    d = d.withColumn("body", F.expr(f"substring({line}, 28)"))
    d = d.withColumn("topic", F.substring_index("body", " ", 1))
    d = d.withColumn("payload", F.when(F.instr("body", " ") > 0, F.expr("substring(body, instr(body, ' ') + 1)")).otherwise(""))
    return d.withColumn("ts_ms", U.ulid_ms(F.col("ulid")))


def read(spark: SparkSession, folder: str, low: str | None = None, high: str | None = None, pattern: str = "*.{flushed,reading}") -> DataFrame:
    """Records of the queryable segments in a folder. A range skips whole files by their names, and other records by their identifiers.

    Lines end at a line feed only. Files with other names are not read (and never deleted). Rows with `bad` are no records.
    """
    d = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder)
    name = F.col("_metadata.file_name")
    # conditions on the file's name alone, so that files are skipped before they are opened
    d = d.where(name.rlike(NAME))
    if high is not None:
        d = d.where(F.substring(name, 1, 26) <= high)
    if low is not None:
        d = d.where(F.substring(name, 28, 26) >= low)
    d = take_apart(d.select("value", name.alias("segment"), F.col("_metadata.file_size").alias("segment_bytes"))).drop("value")
    if low is not None:
        d = d.where(F.col("bad") | (F.col("ulid") >= low))
    if high is not None:
        d = d.where(F.col("bad") | (F.col("ulid") <= high))
    return d


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder with path, size and modification time: names only, no content (one short row a file, as for any read of the folder)."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File]
    rows = pa.table({
        "path": pa.array([f.path for f in found], pa.string()),
        "size_bytes": pa.array([f.size for f in found], pa.int64()),
        "mtime_ms": pa.array([f.mtime_ns // 1_000_000 if f.mtime_ns else None for f in found], pa.int64()),
    })
    # files here need no volume in their path
    return segments.with_name(spark.createDataFrame(rows))


def _lines(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    """Lines of a file with their line ends; one that is cut off has none."""
    with fs.open_input_stream(path) as f:
        rest = b""
        while chunk := f.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                yield line + b"\n"
        if rest:
            yield rest


def _same(fs: pafs.FileSystem, a: str, b: str) -> bool:
    if fs.get_file_info(a).size != fs.get_file_info(b).size:
        return False
    with fs.open_input_stream(a) as x, fs.open_input_stream(b) as y:
        while True:
            one, other = x.read(1 << 20), y.read(1 << 20)
            if one != other:
                return False
            if not one:
                return True


def put_in_place(fs: pafs.FileSystem, path: str, name: str) -> None:
    """Give a finished segment file its name. A file that has that name already is never lost: the same content is an earlier attempt's,
    other content is merged with it in order (records of the one that was there come first, and count where identifiers are equal)."""
    if path == name:
        return
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        fs.move(path, name)
        return
    if not _same(fs, path, name):
        both = f"{name}.{uuid.uuid4().hex}.active"
        last = None
        try:
            with fs.open_output_stream(both) as out:
                for line in heapq.merge(_lines(fs, name), _lines(fs, path), key=lambda x: x[:26].upper()):
                    if line[:26].upper() != last or len(line) < 28:
                        out.write(line if line.endswith(b"\n") else line + b"\n")
                    last = line[:26].upper()
        except BaseException:
            fs.delete_file(both)
            raise
        fs.move(both, name)
    fs.delete_file(path)


def recover_file(fs: pafs.FileSystem, path: str) -> bool:
    """After a crash: a file that was being written gets its range as name, without a last line that is cut off; one in another state is
    flushed again. Whether that was done (a file without any record stays)."""
    if not path.endswith(".active"):
        put_in_place(fs, path, f"{path.rpartition('.')[0]}.flushed")
        return True
    low = high = None
    cut = False
    for line in _lines(fs, path):
        cut = not line.endswith(b"\n")
        name = line[:26].decode("ascii", "replace").upper()
        if not cut and line[26:27] == b" " and _ULID.fullmatch(name):
            low, high = min(low or name, name), max(high or name, name)
    if low is None:
        return False
    if cut:
        whole = f"{path}.{uuid.uuid4().hex}.active"
        with fs.open_output_stream(whole) as out:
            for line in _lines(fs, path):
                if line.endswith(b"\n"):
                    out.write(line)
        fs.delete_file(path)
        path = whole
    put_in_place(fs, path, f"{path.rpartition('/')[0]}/{low}-{high}.flushed")
    return True


def per_file(paths: DataFrame, folder: str, act: Callable[[pafs.FileSystem, str], bool]) -> int:
    """Do something with each file of a table (path), in tasks; for how many it was done. A task that is run again must do no harm."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            done = [act(fs, p) for p in b.column("path").to_pylist() if fs.get_file_info(p).type == pafs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array([sum(done)], pa.int64())], ["n"])

    return paths.select("path").mapInArrow(apply, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def write(records: DataFrame, folder: str, target: int = 128 << 20, state: str = "flushed", durable: bool = False, starts: list[str] | None = None) -> DataFrame:
    """Records (ulid, raw, and perhaps src) as segment files of about `target` bytes; low, high, n_records and n_bytes of each file.

    Every task gets a range of identifiers and writes it in order, dropping repeats, into files that are closed by the record with
    which they reach the target; of copies the one of the lowest src counts. starts: identifiers in order; no file goes from below one of
    them to it or beyond. A file is complete before it has its name (see put_in_place), and is deleted if the task fails. What
    a killed task leaves ends in `.active`, which no reader takes and LogStore.recover() knows. durable: files are on disk, not only in
    the system's buffers, before they have a name (local and mounted folders; object stores and HDFS do it anyway).
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        temporary = f"{root}/{TaskContext.get().stageId()}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.active"
        sink, low, last, n, size, until = None, "", "", 0, 0, ""

        def close() -> pa.RecordBatch:
            sink.close()
            if durable and isinstance(fs, pafs.LocalFileSystem):
                with open(temporary, "rb") as f:
                    os.fsync(f.fileno())
            put_in_place(fs, temporary, f"{root}/{low}-{last}.{state}")
            return pa.RecordBatch.from_pylist([{"low": low, "high": last, "n_records": n, "n_bytes": size}])

        try:
            for b in batches:
                u = b.column("ulid")
                new = pa.array(np.append(u[:1].to_pylist() != [last], pc.not_equal(u[1:], u[:-1]).to_numpy(zero_copy_only=False)).astype(bool)[: len(u)])
                u, raw = u.filter(new).to_pylist(), b.column("raw").filter(new).cast(pa.large_binary())
                # all lines one after the other in one buffer, of which each file gets a stretch
                lines = pc.binary_join_element_wise(raw, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
                ends, text = np.append(0, np.cumsum(pc.binary_length(lines).to_numpy())), lines.buffers()[2]
                at = 0
                while at < len(u):
                    if sink is not None and u[at] >= until:
                        yield close()
                        sink = None
                    if sink is None:
                        sink, low, n, size = fs.open_output_stream(temporary), u[at], 0, 0
                        until = begins[bisect.bisect_right(begins, low)]
                    # up to the line that reaches the target, if `until` doesn't come before
                    to = min(int(np.searchsorted(ends, ends[at] + max(target - size, 1))), bisect.bisect_left(u, until, at), len(u))
                    sink.write(text[int(ends[at]) : int(ends[to])])
                    last, n, size, at = u[to - 1], n + to - at, size + int(ends[to] - ends[at]), to
                    if size >= target:
                        yield close()
                        sink = None
            if sink is not None:
                yield close()
                sink = None
        finally:
            if sink is not None and fs.get_file_info(temporary).type == pafs.FileType.File:
                sink.close()
                fs.delete_file(temporary)

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    begins = [*(starts or []), "~"]  # behind all identifiers
    order = ["ulid", *(["src"] if "src" in records.columns else [])]
    d = records.where("ulid is not null and raw is not null").select(*order, "raw").repartitionByRange("ulid").sortWithinPartitions(*order)
    return d.mapInArrow(apply, "low string, high string, n_records bigint, n_bytes bigint")

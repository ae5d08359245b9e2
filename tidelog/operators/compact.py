"""Far too many small files: a plan that puts them into few well-sized ones, and its execution.

Method: balanced longest-first scheduling. The small files of a volume get a fixed number of output groups, and go, longest
first, to the least loaded one (a heap); if a group comes out too large there is one group more. A volume with very many
files is split into parts by hash first, so no volume is one task's. Each group is then streamed through pyarrow by one task, its
output read again and compared with what went in, and a manifest of all outputs is moved into place as the last step.
`plan` says what goes where, and `consolidate` does it if the plan has paths.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = 128 << 20
SMALL = 16 << 20
PART_FILES = 20_000
MOST_LARGE = 100_000  # volumes of more than PART_FILES files that are broadcast by name; beyond it they are joined


def schedule(sizes: list[int], capacity: int) -> list[int]:
    """Group of each size (they come longest first): as few groups as longest-first needs to keep each within capacity.

    A size above capacity gets a group that holds nothing else.
    """
    large = 0
    while large < len(sizes) and sizes[large] > capacity:
        large += 1
    rest = sizes[large:]
    n = max(1, -(-sum(rest) // capacity)) if rest else 0
    while n:
        heap, groups = [(0, k) for k in range(n)], []
        for size in rest:
            load, k = heap[0]
            if load + size > capacity:
                break
            heapq.heapreplace(heap, (load + size, k))
            groups.append(k)
        if len(groups) == len(rest):
            return [*range(n, n + large), *groups]
        n += max(1, n // 50)
    return list(range(large))


def _schedule_parts(capacity: int):
    """Rows come by volume and part, longest first; each gets the number of its group."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                groups = schedule(t["size"].to_pylist(), capacity)
                yield from t.append_column("output", pa.array(groups, pa.int32())).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            volume, part = b.column("volume").to_pylist(), b.column("part").to_pylist()
            edges = [0, *(k for k in range(1, b.num_rows) if volume[k] != volume[k - 1] or part[k] != part[k - 1]), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if (volume[lo], part[lo]) != key:
                    yield from out()
                    key, held = (volume[lo], part[lo]), []
                held.append(b.slice(lo, hi - lo))
        yield from out()

    return apply


def plan(files: DataFrame, target: int = TARGET, small: int = SMALL, part_files: int = PART_FILES) -> DataFrame:
    """volume, part, low, high, size, (path,) and output (number of the output file in its part) of each file to be rewritten.

    files: volume, low, high, size and perhaps path, one row a file. Rewritten are files below `small` in volumes with two or more of them;
    files of unknown size (null) or with another null stay as they are.
    """
    more = ["path"] if "path" in files.columns else []
    d = files.where(F.col("size") < small).where("volume is not null and low is not null and high is not null").select("volume", "low", "high", F.col("size").cast("bigint").alias("size"), *more)
    n = d.groupBy("volume").agg(F.count(F.lit(1)).alias("n"))
    # volumes of several parts are known by a short list, so that the join below has no large key
    large = n.where(F.col("n") > part_files)
    few = large.limit(MOST_LARGE + 1).count() <= MOST_LARGE
    large = large.select("volume", F.col("n").alias("n_large"))
    d = d.join(F.broadcast(large) if few else large, "volume", "left")
    rest = d.where("n_large is null").join(n.where((F.col("n") > 1) & (F.col("n") <= part_files)), "volume")
    d = rest.unionByName(d.where("n_large is not null").withColumn("n", F.col("n_large"))).drop("n_large")
    d = d.withColumn("part", F.pmod(F.xxhash64("low", "high"), F.ceil(F.col("n") / part_files)).cast("int")).select("volume", "part", "low", "high", "size", *more)
    d = d.repartition("volume", "part").sortWithinPartitions("volume", "part", F.desc("size"), "low", "high")
    return d.mapInArrow(_schedule_parts(target), f"volume string, part int, low string, high string, size bigint, {'path string, ' if more else ''}output int")


def output_name(plan: DataFrame) -> DataFrame:
    """A plan with `output` as text, unique over volumes and parts: what consolidate() takes."""
    return plan.withColumn("output", F.format_string("%s-%05d-%05d", F.regexp_replace("volume", "[^A-Za-z0-9._-]", "_"), "part", "output"))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _batches(uris: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in uris:
        fs, path = _open(uri)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches()


def _copy_parquet(uris: list[str], fs: pafs.FileSystem, out: str) -> int:
    """Inputs into one file, which is then compared with them, batch by batch; the number of rows. All must have one schema."""
    rows, writer = 0, None
    with fs.open_output_stream(out) as sink:
        for b in _batches(uris):
            writer = writer or pq.ParquetWriter(sink, b.schema, compression="zstd")
            writer.write_batch(b)
            rows += b.num_rows
        if writer:
            writer.close()
    if not writer:
        fs.delete_file(out)
        return 0
    with fs.open_input_file(out) as f:
        made, rest = pq.ParquetFile(f).iter_batches(), None
        for b in _batches(uris):
            at = 0
            while at < b.num_rows:
                rest = rest if rest is not None and rest.num_rows else next(made, None)
                n = min(b.num_rows - at, rest.num_rows) if rest is not None else 0
                if not n or not rest.slice(0, n).equals(b.slice(at, n)):
                    raise OSError(f"{out} does not hold what was written")
                at, rest = at + n, rest.slice(n)
        if (rest is not None and rest.num_rows) or next(made, None) is not None:
            raise OSError(f"{out} holds more than was written")
    return rows


def _chunks(uris: list[str]) -> Iterator[bytes]:
    """The bytes of all files, with a line end after a last line that has none."""
    for uri in uris:
        fs, path = _open(uri)
        last = b"\n"
        with fs.open_input_stream(path) as f:
            while chunk := f.read(1 << 20):
                yield chunk
                last = chunk[-1:]
        if last != b"\n":
            yield b"\n"


def _copy_lines(uris: list[str], fs: pafs.FileSystem, out: str) -> int:
    """Inputs into one file, which is then compared with them; the number of lines."""
    rows = 0
    with fs.open_output_stream(out) as sink:
        for chunk in _chunks(uris):
            sink.write(chunk)
            rows += chunk.count(b"\n")
    with fs.open_input_stream(out) as f:
        for chunk in _chunks(uris):
            if f.read(len(chunk)) != chunk:
                raise OSError(f"{out} does not hold what was written")
        if f.read(1):
            raise OSError(f"{out} holds more than was written")
    return rows


def consolidate(groups: DataFrame, folder: str, form: str = "parquet") -> DataFrame:
    """Rewrite files by a plan with the files' URIs: groups has `output` (text, unique to an output file) and `path`.

    form 'parquet' (files of one output have one schema) or 'lines'. Every task streams its groups, reads the outputs again and compares them
    with the inputs. The manifest is a table of its own for each run; the driver then moves the file `manifest`, which names it, into place in
    `folder`, as the last step. Until then the manifest before it stands, and nothing refers to the outputs, so a lost task or driver does no
    harm; after it, inputs may be deleted. Returns output, file, n_files and n_rows of the manifest. Inputs without any row make no file (null).
    """
    spark = groups.sparkSession

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        key, paths = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            name = f"{key}-{attempt}.{'parquet' if form == 'parquet' else 'flushed'}"
            n = (_copy_parquet if form == "parquet" else _copy_lines)(paths, fs, f"{root}/{name}")
            made = fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File
            yield pa.RecordBatch.from_pylist([{"output": key, "file": name if made else None, "n_files": len(paths), "n_rows": n}], schema)

        schema = pa.schema([("output", pa.string()), ("file", pa.string()), ("n_files", pa.int64()), ("n_rows", pa.int64())])
        for b in batches:
            for o, p in zip(b.column("output").to_pylist(), b.column("path").to_pylist()):
                if o != key:
                    yield from out()
                    key, paths = o, []
                paths.append(p)
        yield from out()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    d = groups.where("output is not null and path is not null").select("output", "path").repartition("output").sortWithinPartitions("output", "path")
    table = f"_manifests/{uuid.uuid4().hex}"
    d.mapInArrow(apply, "output string, file string, n_files bigint, n_rows bigint").write.parquet(f"{folder}/{table}")
    made = spark.read.parquet(f"{folder}/{table}")
    total = made.agg(F.count(F.lit(1)).alias("outputs"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first().asDict()
    with fs.open_output_stream(f"{root}/{table}.tmp") as f:
        f.write(json.dumps({"table": table} | total).encode())
    fs.move(f"{root}/{table}.tmp", f"{root}/manifest")
    return made


def published(spark, folder: str) -> DataFrame | None:
    """The manifest that stands in a folder, or None."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/manifest").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/manifest") as f:
        return spark.read.parquet(f"{folder}/{json.loads(f.read())['table']}")

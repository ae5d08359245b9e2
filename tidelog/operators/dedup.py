"""Messages delivered more than once: exactly one copy of each comes out, and the others are named.

Method: an index of sorted identifier arrays, split by hash prefix. Batches are taken in one after the other. Of each, repeats inside
it are settled first (on the map side, before any shuffle); what is left is binary-searched in the index's runs of its prefix, and
the identifiers form a new immutable run there. Runs are merged periodically, by levels: FAN runs of a level make one of the next, so
an identifier is written again a logarithmic number of times. Runs are files in a folder that all executors share; a manifest names
those that count. It is written after the job that made them, so a lost executor or driver leaves files that nothing names.

The kept copy of an identifier is the one with the lowest src, then the lowest row_id, over all batches seen so far; a
later batch may bring a better copy, and then the one kept until now is named as superseded. A null src comes last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.scale import partitions_for, shared_dir, written

FAN = 4
HOT_AT = 8
HOT_MOST = 65_536
EPOCHS = 4
NO_SRC = (1 << 31) - 1
PARTITION_BYTES = 512 << 20  # a reduce task holds one prefix at a time, a fourth of this or less

#: A run: identifiers in ascending order without repeats, and src, row_id and tag of each one's best copy.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Copies that have lost: row_id and tag.
Lost = tuple[np.ndarray, np.ndarray]


def best_of(ids: np.ndarray, src: np.ndarray, row: np.ndarray, tag: np.ndarray) -> tuple[Run, Lost]:
    """The run of the best copies, and all others."""
    order = np.lexsort((row, src, ids))
    ids, src, row, tag = ids[order], src[order], row[order], tag[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return (ids[first], src[first], row[first], tag[first]), (row[~first], tag[~first])


def merge(runs: list[Run]) -> Run:
    """One run with the best copy of each identifier of several runs."""
    return best_of(*(np.concatenate(x) for x in zip(*runs)))[0] if len(runs) > 1 else runs[0]


def look_up(runs: list[Run], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of sorted identifiers in all runs: whether found, and src, row_id and tag of the best copy."""
    found, src, row, tag = np.zeros(len(ids), bool), np.full(len(ids), NO_SRC, np.int64), np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
    for r_ids, r_src, r_row, r_tag in runs:
        at = np.minimum(np.searchsorted(r_ids, ids), len(r_ids) - 1)
        hit = r_ids[at] == ids
        better = hit & ((r_src[at] < src) | (r_src[at] == src) & (r_row[at] < row))
        src, row, tag, found = np.where(better, r_src[at], src), np.where(better, r_row[at], row), np.where(better, r_tag[at], tag), found | hit
    return found, src, row, tag


def admit(runs: list[Run], ids: np.ndarray, src: np.ndarray, row: np.ndarray, tag: np.ndarray) -> tuple[Run, Lost]:
    """A batch against the runs: the new run it gives (it may be empty), and the copies that are not kept any more."""
    (ids, src, row, tag), lost = best_of(ids, src, row, tag)
    found, o_src, o_row, o_tag = look_up(runs, ids)
    wins = ~found | (src < o_src) | (src == o_src) & (row < o_row)
    gone = [np.concatenate([x, mine[~wins], theirs[found & wins]]) for x, mine, theirs in zip(lost, (row, tag), (o_row, o_tag))]
    return (ids[wins], src[wins], row[wins], tag[wins]), tuple(gone)


class Levels:
    """Runs by level: when FAN of a level are there, they become one of the next."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Run]] = []

    def add(self, run: Run, level: int = 0) -> None:
        if len(run[0]):
            self.held.append((level, run))
        while len(mine := [r for k, r in self.held if k == level]) >= FAN:
            self.held = [x for x in self.held if x[0] != level]
            level += 1
            self.held.append((level, merge(mine)))

    @property
    def runs(self) -> list[Run]:
        return [r for _, r in self.held]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: repeats inside a batch, and of identifiers that are frequent in this partition, are settled before the shuffle."""
    hot: dict[bytes, tuple[int, int, int]] = {}

    def out(ids: list | np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *[pa.array(x, pa.int64()) for x in rest]], ["ulid", "src", "row_id", "tag"])

    for b in batches:
        ids = np.array(b.column("ulid").to_pylist(), "S26")
        if not len(ids):
            continue
        names, count = np.unique(ids, return_counts=True)
        (ids, src, row, tag), (lost, lost_tag) = best_of(ids, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "row_id", "tag")))
        keep, more = np.ones(len(ids), bool), []
        for k in np.flatnonzero((count >= HOT_AT) | np.array([x in hot for x in names.tolist()])) if hot or (count >= HOT_AT).any() else ():
            name, mine = bytes(ids[k]), (int(src[k]), int(row[k]), int(tag[k]))
            if name in hot or len(hot) < HOT_MOST:
                keep[k] = False
                old = hot.get(name)
                hot[name] = mine if old is None else min(mine, old)
                if old is not None:
                    more.append(max(mine, old)[1:])
        if more:
            lost, lost_tag = np.append(lost, [m[0] for m in more]), np.append(lost_tag, [m[1] for m in more])
        yield out(ids[keep].astype("U26"), src[keep], row[keep], tag[keep])
        if len(lost):
            yield out([None] * len(lost), np.zeros(len(lost), np.int64), lost, lost_tag)
    if hot:
        yield out([k.decode() for k in hot], *(np.array(x) for x in zip(*hot.values())))


def _write_run(fs: pafs.FileSystem, path: str, run: Run) -> None:
    with fs.open_output_stream(path) as f:
        pq.write_table(pa.table({"ulid": pa.array(run[0].astype("U26"), pa.string()), "src": run[1], "row_id": run[2], "tag": run[3]}), f, compression="zstd")


def _read_run(fs: pafs.FileSystem, path: str) -> Run:
    with fs.open_input_file(path) as f:
        t = pq.read_table(f)
    return np.array(t["ulid"].to_pylist(), "S26"), t["src"].to_numpy(), t["row_id"].to_numpy(), t["tag"].to_numpy()


_MADE = pa.schema([("row_id", pa.int64()), ("tag", pa.int64()), ("prefix", pa.int32()), ("run", pa.string()), ("level", pa.int32()), ("merged", pa.list_(pa.string())), ("searched", pa.int32())])


class DedupIndex:
    """An index of identifiers in a shared folder, to which batches are added one after the other (by one writer).

    runs: names and levels of the runs by prefix. searched: how many earlier runs the last batch was searched in.
    """

    def __init__(self, spark: SparkSession, path: str, prefixes: int = 256):
        self.spark, self.path = spark, path
        self.fs, self.root = pafs.FileSystem.from_uri(path)
        self.epoch, self.prefixes, self.runs, self.searched = -1, prefixes, {}, 0
        self.fs.create_dir(self.root, recursive=True)
        names = [f.path for f in self.fs.get_file_info(pafs.FileSelector(self.root)) if f.base_name.startswith("manifest-")]
        if names:
            with self.fs.open_input_stream(max(names)) as f:
                m = json.loads(f.read())
            self.epoch, self.prefixes, self.runs = m["epoch"], m["prefixes"], {int(k): v for k, v in m["runs"].items()}

    def add(self, rows: DataFrame, epoch: int | None = None) -> DataFrame:
        """Take in rows (ulid, src, row_id, and perhaps a bigint `tag` that goes with a row) as the batch `epoch`; row_id and tag of all
        rows that are no kept copies now.

        A batch whose epoch is in the index already is not taken again (its result is returned again), so a retried micro-batch
        does no harm. Rows with a null ulid or row_id are no deliveries and are ignored. An empty batch gives an empty result.
        """
        epoch = self.epoch + 1 if epoch is None else epoch
        made = f"{self.path}/batch-{epoch:08d}"
        if epoch <= self.epoch:
            return self.lost([epoch])
        uri, prefixes, runs = self.path, self.prefixes, self.runs
        shift = 64 - (prefixes - 1).bit_length()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Reduce side: rows come by prefix, so the runs of one prefix at a time are held."""
            from pyspark import TaskContext

            fs, root = pafs.FileSystem.from_uri(uri)
            attempt = TaskContext.get().taskAttemptId()
            now, old, new = -1, [], Levels()

            def finish() -> Iterator[pa.RecordBatch]:
                if not new.held:
                    return
                run, level, merged = merge(new.runs), 0, []
                # with FAN - 1 runs of its level it makes one of the next
                while len(same := [x for x in old if x[1] == level]) >= FAN - 1:
                    run, level, merged = merge([run, *(x[2] for x in same)]), level + 1, merged + [x[0] for x in same]
                name = f"prefix-{now:05d}-{epoch:08d}-{attempt}.parquet"
                _write_run(fs, f"{root}/{name}", run)
                yield pa.RecordBatch.from_pylist([{"prefix": now, "run": name, "level": level, "merged": merged, "searched": len(old)}], _MADE)

            for b in batches:
                p, ulid = b.column("prefix").to_numpy(), b.column("ulid")
                src, row, tag = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "row_id", "tag"))
                valid = ulid.is_valid().to_numpy(zero_copy_only=False)
                ids = np.array(ulid.fill_null("").to_pylist(), "S26")
                edges = np.flatnonzero(np.diff(p)) + 1
                for lo, hi in zip([0, *edges], [*edges, len(p)]):
                    if lo == hi:
                        continue
                    if p[lo] != now:
                        yield from finish()
                        now, new = int(p[lo]), Levels()
                        old = [(name, level, _read_run(fs, f"{root}/{name}")) for name, level in runs.get(now, [])]
                    ok = valid[lo:hi]
                    lost, lost_tag = row[lo:hi][~ok], tag[lo:hi][~ok]
                    if ok.any():
                        run, gone = admit([x[2] for x in old] + new.runs, ids[lo:hi][ok], src[lo:hi][ok], row[lo:hi][ok], tag[lo:hi][ok])
                        lost, lost_tag = np.concatenate([lost, gone[0]]), np.concatenate([lost_tag, gone[1]])
                        new.add(run)
                    if n := len(lost):
                        yield pa.RecordBatch.from_arrays([pa.array(lost), pa.array(lost_tag), *[pa.nulls(n, f.type) for f in list(_MADE)[2:]]], schema=_MADE)
            yield from finish()

        tag = F.col("tag").cast("bigint") if "tag" in rows.columns else F.lit(0).cast("bigint")
        d = rows.where("ulid is not null and row_id is not null").select(F.col("ulid"), F.coalesce(F.col("src").cast("bigint"), F.lit(NO_SRC).cast("bigint")).alias("src"), F.col("row_id").cast("bigint").alias("row_id"), tag.alias("tag"))
        d = d.mapInArrow(_settle, "ulid string, src bigint, row_id bigint, tag bigint")
        # a row that has lost already goes anywhere
        d = d.withColumn("prefix", F.shiftrightunsigned(F.coalesce(F.xxhash64("ulid"), F.xxhash64("row_id")), shift).cast("int") if prefixes > 1 else F.lit(0))
        d = d.repartition(partitions_for(rows, PARTITION_BYTES), "prefix").sortWithinPartitions("prefix")
        d.mapInArrow(apply, "row_id bigint, tag bigint, prefix int, run string, level int, merged array<string>, searched int").write.mode("overwrite").parquet(made)
        self.searched = 0
        # as many rows as prefixes have changed
        for r in self.spark.read.parquet(made).where("run is not null").collect():
            self.runs[r.prefix] = [*(x for x in self.runs.get(r.prefix, []) if x[0] not in r.merged), [r.run, r.level]]
            self.searched += r.searched
        self.epoch = epoch
        with self.fs.open_output_stream(f"{self.root}/manifest-{epoch:08d}.tmp") as f:
            f.write(json.dumps({"epoch": epoch, "prefixes": prefixes, "runs": self.runs}).encode())
        self.fs.move(f"{self.root}/manifest-{epoch:08d}.tmp", f"{self.root}/manifest-{epoch:08d}")
        return self.lost([epoch])

    def lost(self, epochs: list[int]) -> DataFrame:
        """row_id and tag of what the batches have superseded. (A copy that a later batch beat is named there.)"""
        return self.spark.read.parquet(*[f"{self.path}/batch-{e:08d}" for e in epochs]).where("run is null").select("row_id", "tag")


def fresh_index(rows: DataFrame, path: str | None = None) -> DedupIndex:
    """An empty index with as many prefixes as the table `rows` needs."""
    n = 4 * partitions_for(rows, PARTITION_BYTES)
    return DedupIndex(rows.sparkSession, path or shared_dir(rows.sparkSession, "dedup"), 1 << max(3, (n - 1).bit_length()))


def epoch_of(table: DataFrame, batch: str, epochs: int = EPOCHS) -> Column:
    """An expression for the number of the range of batches that a row's batch is in: `epochs` ranges of about as many rows each, in order of
    the batches (a null batch is in the first). One pass over that column."""
    cuts = table.agg(F.percentile_approx(batch, [k / epochs for k in range(1, epochs)], 1000).alias("c")).first().c or []
    return sum((F.coalesce((F.col(batch) > c).cast("int"), F.lit(0)) for c in sorted(set(cuts))), F.lit(0))


def superseded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """row_id of every row (ulid, src, row_id, and perhaps an int `epoch`) that is not the kept copy of its message, by a fresh index.

    With `epoch` the batches of rows come in one after the other, in that order, and each is searched in the runs of those before it.
    The rows are then written once, by epoch, so that what makes them runs once.
    """
    index = fresh_index(rows, path)
    if "epoch" not in rows.columns:
        return index.add(rows.select("ulid", "src", "row_id")).select("row_id")
    folder = shared_dir(rows.sparkSession, "batches")
    rows.select("ulid", "src", "row_id", "epoch").write.partitionBy("epoch").parquet(folder)
    read = rows.sparkSession.read.schema("ulid string, src int, row_id bigint, epoch int").parquet(folder)
    # one row an epoch
    for e in sorted(r.epoch for r in read.select("epoch").distinct().collect()):
        index.add(read.where(F.col("epoch") == e).drop("epoch"))
    return index.lost(list(range(index.epoch + 1))).select("row_id") if index.epoch >= 0 else rows.where("false").select("row_id")


def settled(rows: DataFrame, where: str = "true", what: str = "rows") -> DataFrame:
    """rows (ulid, src, row_id, ...) without superseded copies, as far as `where` (a condition on rows) wants them.

    Copies are settled on identifier, src and row_id alone, by a fresh index: all other columns stay where they are. rows are written once, each
    with a number that names the task which wrote it; the copies that have lost are put in one list a task, and whoever reads a row
    looks it up in the list of its task. So rows are neither shuffled nor joined. Rows with a null ulid or row_id are left out; of
    repeated rows one stays.
    """
    spark = rows.sparkSession
    table = written(rows.where("ulid is not null and row_id is not null").withColumn("_id", F.monotonically_increasing_id()), what)
    index = fresh_index(table.select("ulid", "src", "row_id", "_id"))
    lost = index.add(table.select("ulid", "src", "row_id", F.col("_id").alias("tag")))
    folder = shared_dir(spark, "lost")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, held = None, []

        def write() -> pa.RecordBatch:
            # whole before it has its name: a second attempt of this task may still run when the list is read
            with fs.open_output_stream(f"{root}/{now}-{attempt}") as f:
                f.write(np.sort(np.concatenate(held)).tobytes())
            fs.move(f"{root}/{now}-{attempt}", f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], ["part"])

        for b in batches:
            tag = b.column("tag").to_numpy()
            part = tag >> 33
            edges = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(part)]):
                if lo == hi:
                    continue
                if part[lo] != now:
                    if held:
                        yield write()
                    now, held = int(part[lo]), []
                held.append(tag[lo:hi])
        if held:
            yield write()

    parts = F.shiftright("tag", 33)
    # the lists are there when this has been written
    written(lost.select("tag", parts.alias("part")).repartition("part").sortWithinPartitions("part").select("tag").mapInArrow(lists, "part bigint"), "lost-parts")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        known: dict[int, np.ndarray] = {}
        for b in batches:
            id_ = b.column("_id").to_numpy()
            part, keep = id_ >> 33, np.ones(len(id_), bool)
            for p in np.unique(part).tolist():
                if p not in known:
                    if len(known) > 8:
                        known.clear()
                    path = f"{root}/{p}"
                    if fs.get_file_info(path).type == pafs.FileType.File:
                        with fs.open_input_stream(path) as f:
                            known[p] = np.frombuffer(f.read(), np.int64)
                    else:
                        known[p] = np.zeros(0, np.int64)
                gone = known[p]
                if len(gone):
                    mine = part == p
                    at = np.minimum(np.searchsorted(gone, id_[mine]), len(gone) - 1)
                    keep[mine] = gone[at] != id_[mine]
            yield b.filter(pa.array(keep)) if not keep.all() else b

    out = table.where(where)
    return out.mapInArrow(drop, out.schema).drop("_id")


def kept(rows: DataFrame, key: str = "ulid", by: tuple[str, ...] = ("src", "row_id")) -> DataFrame:
    """The kept copy of each key, with all columns: one aggregate, combined on the map side, so a hot key sends one row a task.

    Rows with a null key are left out; nulls in `by` come last; full ties keep one of the equal rows.
    """
    rest = [c for c in rows.columns if c not in (key, *by)]
    order = [F.struct(F.col(c).isNull(), F.col(c)) for c in by]
    best = F.min_by(F.struct(*[F.col(c) for c in (*by, *rest)]), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_best")).select(key, "_best.*")

"""Overlapping and gapped intervals: continuous periods per entity, and the gaps between them.

Method: the time line is cut into shards, and each interval into a piece in its first shard, one in its last, and one cover
of the whole shards between. The pieces of an entity in a shard are a bitmap over exact time units, kept as runs of set units
(RunBitmap); bitmaps are united, on the map side and again per shard, and set runs and clear runs are read off. What goes on from
shard to shard is settled from two runs a shard, so no entity is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import ulid as U
from tidelog.functions.scale import written

SHARD_MS = 1 << 25  # about nine hours


class RunBitmap:
    """Bitmaps over time of many entities and shards, each a container of runs.

    Time is discretised exactly, to the units that occur: in a container, unit 2k is the k-th of its end points, and unit 2k + 1 the open
    stretch after it, so no interval begins or ends inside a unit, and intervals that only follow one another leave a clear unit between. A run
    is its first unit and how many units are set from there on. Units are numbered through all containers, whose last stretch is always clear.
    """

    __slots__ = ("at", "entity", "key", "length", "shard", "start")

    def __init__(self, entity: list, shard: np.ndarray, key: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray):
        #: entity and shard of each container; container, first unit and length of each run, in order; the time of each even unit.
        self.entity, self.shard, self.key, self.at, self.start, self.length = entity, shard, key, at, start, length

    @staticmethod
    def of(entity: list, shard: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> RunBitmap:
        """From intervals (container, low and high end) in any order."""
        n = len(low)
        both, at = np.concatenate([key, key]), np.concatenate([low, high])
        order = np.lexsort((at, both))
        both, at = both[order], at[order]
        new = np.ones(2 * n, bool)
        new[1:] = (both[1:] != both[:-1]) | (at[1:] != at[:-1])
        unit = np.empty(2 * n, np.int64)
        unit[order] = 2 * (np.cumsum(new) - 1)
        return RunBitmap(entity, shard, both[new], at[new], *_coalesced(unit[:n], unit[n:])).compact()

    def compact(self) -> RunBitmap:
        """Without units that lie inside runs: what is left of the time line are the runs' ends. `key` is from now on that of each run."""
        first, last = self.start // 2, (self.start + self.length - 1) // 2
        key = self.key[first] if len(self.key) == len(self.at) else self.key
        used = np.zeros(len(self.at), bool)
        used[first], used[last] = True, True
        number = np.cumsum(used) - 1
        return RunBitmap(self.entity, self.shard, key, self.at[used], 2 * number[first], 2 * (number[last] - number[first]) + 1)

    def set_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Container, low and high end of each run."""
        return self.key, self.at[self.start // 2], self.at[(self.start + self.length - 1) // 2]

    def clear_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each run whether a clear run of the same container follows before another run, and where that ends."""
        inner = np.zeros(len(self.key), bool)
        inner[:-1] = self.key[1:] == self.key[:-1]
        end = np.empty(len(self.key), self.at.dtype)
        end[:-1] = self.at[self.start[1:] // 2]
        if len(end):
            end[-1:] = b""
        return inner, end

    def union(self, other: RunBitmap) -> RunBitmap:
        """Of bitmaps with the same containers: the units of both are put in one order, and the runs in it united."""
        mine, theirs = self.set_runs(), other.set_runs()
        return RunBitmap.of(self.entity, self.shard, *(np.concatenate(x) for x in zip(mine, theirs)))

    def part(self, lo: int, hi: int) -> RunBitmap:
        """Containers lo to hi alone."""
        a, b = np.searchsorted(self.key, [lo, hi])
        key, low, high = (x[a:b] for x in self.set_runs())
        return RunBitmap.of(self.entity[lo:hi], self.shard[lo:hi], key - lo, low, high)


def _coalesced(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, length) of the units that any of the runs start..end sets."""
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > upto[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
    return start[new], upto[last] - start[new] + 1


class Union:
    """A union of bitmaps as they come: those of like size are united first, so each run is put in order a logarithmic number of times."""

    def __init__(self) -> None:
        self.held: list[RunBitmap] = []

    def add(self, bitmap: RunBitmap) -> None:
        self.held.append(bitmap)
        while len(self.held) > 1 and len(self.held[-2].key) <= 2 * len(self.held[-1].key):
            b, a = self.held.pop(), self.held.pop()
            self.held.append(a.union(b))

    def take(self) -> RunBitmap:
        while len(self.held) > 1:
            b, a = self.held.pop(), self.held.pop()
            self.held.append(a.union(b))
        return self.held.pop()


def _bitmap(b: pa.RecordBatch, in_order: bool) -> RunBitmap:
    """A batch of pieces (entity, shard, low, high). in_order: they come by entity and shard, and so do the containers."""
    coded = b.column("entity").dictionary_encode()
    names, code, shard = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), b.column("shard").to_numpy()
    order = np.arange(len(code)) if in_order else np.lexsort((shard, code))
    c, s = code[order], shard[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    key = np.empty(len(c), np.int64)
    key[order] = np.cumsum(new) - 1
    low, high = (np.array(b.column(x).to_pylist(), "S26") for x in ("low", "high"))
    return RunBitmap.of([names[k] for k in c[new].tolist()], s[new], key, low, high)


def _unite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the pieces of one batch united."""
    for b in batches:
        if b.num_rows:
            m = _bitmap(b, False)
            key, low, high = m.set_runs()
            entity = pa.array(m.entity, pa.string()).take(pa.array(key))
            yield pa.RecordBatch.from_arrays([entity, pa.array(m.shard[key]), pa.array(low.astype("U26")), pa.array(high.astype("U26"))], ["entity", "shard", "low", "high"])


def _unite_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: rows come by entity and shard. Per shard: its set runs, those at either end marked, each with the end of the clear run after it."""

    def out(m: RunBitmap) -> pa.RecordBatch:
        key, low, high = m.set_runs()
        inner, end = m.clear_runs()
        first = np.ones(len(key), bool)
        first[1:] = ~inner[:-1]
        entity = pa.array(m.entity, pa.string()).take(pa.array(key))
        next_low = pa.array(end.astype("U26"), mask=~inner)
        return pa.RecordBatch.from_arrays([entity, pa.array(m.shard[key]), pa.array(low.astype("U26")), pa.array(high.astype("U26")), pa.array(first | ~inner), next_low], ["entity", "shard", "low", "high", "edge", "next_low"])

    last, held = None, Union()
    for b in batches:
        if not b.num_rows:
            continue
        m = _bitmap(b, True)
        n = len(m.entity)
        if (m.entity[0], m.shard[0]) == last:
            held.add(m.part(0, 1))
            if n == 1:
                continue
            m, n = m.part(1, n), n - 1
        if held.held:
            yield out(held.take())
        if n > 1:
            yield out(m.part(0, n - 1))
        held.add(m.part(n - 1, n))
        last = (m.entity[-1], m.shard[-1])
    if held.held:
        yield out(held.take())


def periods(intervals: DataFrame, shard_ms: int = SHARD_MS) -> DataFrame:
    """entity, kind ('period' or 'gap'), low and high, from intervals (entity string, low and high as upper-case ULIDs).

    Intervals are closed; those that overlap or share an end are one period, and between two neighbouring periods is a gap, from
    the end of the one to the beginning of the next. low may be above high. Rows with a null are left out; repeated rows and
    intervals of no length are fine; an empty table gives no rows. Other columns are ignored.
    """
    d = intervals.where("entity is not null and low is not null and high is not null").select("entity", F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
    d = d.withColumn("a", F.floor(U.ulid_ms(F.col("low")) / shard_ms)).withColumn("b", F.floor(U.ulid_ms(F.col("high")) / shard_ms))
    # where a shard begins: a prefix is below all ULIDs that have it and above all before them, and no ULID equals it
    begin = lambda k: U.encode(k * shard_ms, 10)
    whole = F.col("a") == F.col("b")
    pieces = F.array(
        F.struct(F.col("a").alias("shard"), F.col("low"), F.when(whole, F.col("high")).otherwise(begin(F.col("a") + 1)).alias("high")),
        F.when(~whole, F.struct(F.col("b").alias("shard"), begin(F.col("b")).alias("low"), F.col("high"))),
    )
    cut = d.select("entity", F.explode(F.filter(pieces, lambda x: x.isNotNull())).alias("p")).select("entity", "p.shard", "p.low", "p.high")
    cut = cut.mapInArrow(_unite_batches, "entity string, shard bigint, low string, high string")
    cut = cut.repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    runs = written(cut.mapInArrow(_unite_shards, "entity string, shard bigint, low string, high string, edge boolean, next_low string"), "runs")
    covers = d.where(F.col("b") > F.col("a") + 1).groupBy("entity", (F.col("a") + 1).alias("a")).agg(F.max(F.col("b") - 1).alias("b"))

    # first and last run of each shard, and the covers, in order: the highest end before each. It is read twice below
    ends = runs.where("edge").select("entity", "shard", "low", "high")
    ends = ends.unionByName(covers.select("entity", F.lit(-1).cast("bigint").alias("shard"), begin(F.col("a")).alias("low"), begin(F.col("b") + 1).alias("high")))
    w = Window.partitionBy("entity").orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = written(ends.withColumn("before", before).withColumn("covered", (F.col("shard") >= 0) & F.coalesce(F.col("before") >= begin(F.col("shard") + 1), F.lit(False))), "ends")
    # a shard that lies in a cover adds nothing: all of its runs are in the cover
    covered = ends.where("covered").select("entity", "shard")

    n = F.sum(F.when(F.col("before") >= F.col("low"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = ends.withColumn("n", n).groupBy("entity", "n").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("shard", "low").alias("first"), F.max_by("shard", "high").alias("last"))
    order = Window.partitionBy("entity").orderBy("n")
    # a gap between runs of one shard is among that shard's own
    gap = F.when(F.lead("first").over(order) != F.col("last"), F.lead("low").over(order))
    joined = joined.select("entity", "low", "high", gap.alias("next_low"), F.lit(True).alias("period"))
    own = runs.where("not edge or next_low is not null").join(covered, ["entity", "shard"], "left_anti").select("entity", "low", "high", "next_low", (~F.col("edge")).alias("period"))
    each = F.array(
        F.when(F.col("period"), F.struct(F.lit("period").alias("kind"), F.col("low"), F.col("high"))),
        F.when(F.col("next_low").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("high").alias("low"), F.col("next_low").alias("high"))),
    )
    return joined.unionByName(own).select("entity", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("p")).select("entity", "p.*")

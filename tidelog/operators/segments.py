"""The segment index: file names as zone maps, states, overlaps, islands, packing, retention and statistics.

A segment file is named <ulid>-<ulid>.<state>; its name is its index entry. All functions take and return DataFrames of
the index (one row a file), never the records, so statistics and plans cost no scan of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import ulid as U
from tidelog.functions.scale import before_parts, ordered_parts

_ID = "[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}"
_NAME = rf"^{_ID}-{_ID}\.[A-Za-z]+\z"
_VOLUME = r"^(?:.*/)?([Vv][Oo][Ll]-\d{7})/"
# The characters of U.AROUND, one by one.
_AROUND = " \t\n\x0b\f\r\ufeff\u00a0\u200b"
# The states of a store's segments, and those a query may read.
STATES = ("active", "flushed", "reading", "trashed")
QUERYABLE = ("flushed", "reading")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two closed ranges share a point; each may be given high end first."""
    return (F.least(a, b) <= F.greatest(c, d)) & (F.least(c, d) <= F.greatest(a, b))


def with_name(files: DataFrame, path: str = "path") -> DataFrame:
    """files with volume, low, high and state from a path; all null where it names no segment (also for a null path).

    Letter case, doubled and back slashes, '.' elements, a file: scheme, and white space around the path do not matter.
    """
    # the name is cut off first, so that the expressions below see short texts only
    d = files.drop("volume", "low", "high", "state").withColumn("_t", F.btrim(F.translate(path, "\\", "/"), F.lit(_AROUND)))
    d = d.withColumn("_n", F.substring_index("_t", "/", -1))
    d = d.withColumn("_n", F.when((F.length("_n") > 54) & F.col("_n").rlike(_NAME), F.col("_n")))
    d = d.withColumn("volume", F.when(F.col("_n").isNotNull(), F.lower(F.nullif(F.regexp_extract(F.expr("left(_t, length(_t) - length(_n))"), _VOLUME, 1), F.lit("")))))
    d = d.withColumn("_a", F.upper(F.substring("_n", 1, 26))).withColumn("_b", F.upper(F.substring("_n", 28, 26)))
    return d.withColumn("low", F.least("_a", "_b")).withColumn("high", F.greatest("_a", "_b")).withColumn("state", F.lower(F.expr("substring(_n, 55)"))).drop("_t", "_n", "_a", "_b")


def current(listings: DataFrame, with_path: bool = False) -> DataFrame:
    """One row per segment file (volume, low, high): state of its latest listing, and its last known size (null: never known).

    listings: path, listed_at, seg_no, size. Of listings of the same time the later seg_no counts; a null time is the earliest;
    a null or negative size is unknown; rows that name no segment or no volume are left out; repeated rows do no harm.
    with_path: also the path of the latest listing.
    """
    # rows without a volume are left out at the end, by an aggregate: a filter here would be pushed below the names, and they be made twice
    d = with_name(listings)
    # time and number as one number, and states as numbers: what is aggregated is of fixed width, and so hashed and not sorted
    at = F.coalesce(F.unix_micros(F.col("listed_at").cast("timestamp")), F.lit(-(1 << 55)))
    when = at.cast("decimal(19,0)") * F.expr("10000000000000000000BD") + F.coalesce("seg_no", F.lit(-1)).cast("decimal(19,0)")
    code = F.array_position(F.array(*[F.lit(x) for x in STATES]), F.col("state"))
    d = d.withColumn("_when", when.cast("decimal(38,0)")).withColumn("_code", code)
    known = F.col("size") >= 0
    d = d.groupBy("volume", "low", "high").agg(
        F.max_by("_code", "_when").alias("_code"), F.max_by(F.when(known, F.col("size")), F.when(known, F.col("_when"))).alias("size"), F.bool_or(F.col("volume").isNotNull()).alias("_ok"), *([F.max_by("path", "_when").alias("path")] if with_path else [])
    )
    # a state that isn't among STATES is of no use to anyone: 'other'
    state = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in STATES]), F.nullif(F.col("_code"), F.lit(0)).cast("int")), F.lit("other"))
    return d.where("_ok").select("volume", "low", "high", state.alias("state"), "size", *(["path"] if with_path else []))


def live(listings: DataFrame, with_path: bool = False) -> DataFrame:
    """The current files that a query may read."""
    return current(listings, with_path).where(F.col("state").isin(*QUERYABLE))


def index_of(records: DataFrame, segment: list[str], ulid: str = "ulid", raw: str = "raw") -> DataFrame:
    """Index rows of records that carry their segment's columns: low, high, n_records, size_bytes (with line ends)."""
    return records.groupBy(*segment).agg(F.min(ulid).alias("low"), F.max(ulid).alias("high"), F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length(raw) + 1).alias("size_bytes"))


def pruned(index: DataFrame, low: str, high: str) -> DataFrame:
    """Segments that a query over [low, high] has to read."""
    return index.where(overlap(F.col("low"), F.col("high"), F.lit(low), F.lit(high)))


def scan_stats(index: DataFrame, low: str, high: str) -> DataFrame:
    """The statistics-only query: segments to read and their bytes; no record is read."""
    return pruned(index, low, high).agg(F.count(F.lit(1)).alias("segments_queried"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("max_data_set_size"))


def state_stats(index: DataFrame, states: tuple[str, ...] = STATES, size: str = "size_bytes") -> DataFrame:
    """One row: number of segments and bytes by state."""
    each = []
    for s in states:
        each += [F.count_if(F.col("state") == s).alias(f"{s}_segments"), F.coalesce(F.sum(F.when(F.col("state") == s, F.col(size))), F.lit(0)).alias(f"{s}_bytes")]
    return index.agg(*each)


def overlap_runs(index: DataFrame, key: str) -> DataFrame:
    """All overlaps of different segments, one row a segment: key, position, last_position, n_overlaps.

    Segments are numbered by low end (then key). Those that begin within a segment's range follow it without a break, so the pairs
    (a, b) that overlap are those with a.position < b.position <= a.last_position. n_overlaps is the number of a segment's partners on
    either side: what begins before it ends, less what ends before it begins. Pairs are never made: two rows a segment are put in
    order and counted, in parts. key is unique; rows with a null bound or key are left out; an empty index gives no rows.
    """
    d = index.where(f"{key} is not null and low is not null and high is not null").select(key, F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
    ends = F.array(F.struct(F.col("low").alias("at"), F.lit(0).alias("is_end")), F.struct(F.col("high").alias("at"), F.lit(1).alias("is_end")))
    e = d.select(F.col(key).alias("_key"), F.explode(ends).alias("_e")).select("_key", F.col("_e.at").alias("at"), F.col("_e.is_end").alias("is_end"))
    e = ordered_parts(e, "overlaps", "at", "is_end", "_key")
    before = before_parts(e, starts=F.sum(1 - F.col("is_end")), stops=F.sum("is_end"))
    w = Window.partitionBy("_part").orderBy("at", "is_end", "_key").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_starts", F.sum(1 - F.col("is_end")).over(w)).withColumn("_stops", F.sum("is_end").over(w)).join(before, "_part")
    e = e.select("_key", "is_end", (F.col("_starts") + F.col("starts")).alias("a"), (F.col("_stops") + F.col("stops")).alias("b"))
    first, last, ended = F.max(F.when(F.col("is_end") == 0, F.col("a"))), F.max(F.when(F.col("is_end") == 1, F.col("a"))), F.max(F.when(F.col("is_end") == 0, F.col("b")))
    return e.groupBy(F.col("_key").alias(key)).agg(first.alias("position"), last.alias("last_position"), (last - ended - 1).alias("n_overlaps"))


def compaction_pick(index: DataFrame, key: str, least: int = 3) -> DataFrame:
    """The segment with most overlaps (ties: lowest key) and its partners, if they are `least` or more; else no rows."""
    top = overlap_runs(index, key).orderBy(F.desc("n_overlaps"), key).first()
    if top is None or top.n_overlaps + 1 < least:
        return index.where("false").select(key)
    # one row, by a key that is unique
    ends = index.where(F.col(key) == F.lit(top[key])).select("low", "high").first()
    return index.where(f"{key} is not null and low is not null and high is not null").where(overlap(F.col("low"), F.col("high"), F.lit(ends.low), F.lit(ends.high))).select(key)


def islands(index: DataFrame, group: list[str] | None = None) -> DataFrame:
    """index with `island`: segments in order of low end; one begins a new island if it begins after all before it have ended.

    Islands are numbered in each group (all segments are one without). The order is taken in parts, and what a part needs of the parts
    before it is one row a part and group, so no group is one task's. Rows with a null bound are left out.
    """
    keys = group or []
    d = ordered_parts(index.where("low is not null and high is not null"), "islands", *keys, "low", "high")
    by = Window.partitionBy("_part", *keys).orderBy("low", "high")
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part and group

    def carried(d: DataFrame, value: Column, total) -> DataFrame:
        c = d.groupBy("_part", *keys).agg(value.alias("_carry")).withColumn("_carry", total(F.col("_carry")).over(over))
        same = F.col("d._part") == F.col("c._part")
        for k in keys:
            same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
        return d.alias("d").join(c.alias("c"), same).select("d.*", "c._carry")

    d = carried(d, F.max("high"), F.max)
    before = F.greatest(F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    d = d.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col("low") > F.col("_before")), 1).otherwise(0)).drop("_before", "_carry")
    d = carried(d, F.sum("_new"), F.sum)
    island = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_carry", F.lit(0))
    return d.withColumn("island", island.cast("bigint")).drop("_part", "_new", "_carry")


def overlapping_islands(index: DataFrame, least: int = 2) -> DataFrame:
    """index with `island`: the segments of islands that have `least` or more; all others overlap nothing (or too little)."""
    d = islands(index)
    return d.join(d.groupBy("island").count().where(F.col("count") >= least), "island", "left_semi")


def first_sequential(index: DataFrame, key: str, size: str, target: int, least: int = 2) -> DataFrame:
    """The first run of segments, in order of low end, that fit the target together and are `least` or more (position, key).

    A segment that doesn't fit ends the run if it is long enough; else a new one begins, with it if it fits alone. What a segment
    does depends on all before it, so this is one pass in order over the index (names and sizes, no records), streamed: only the
    run in hand is held, and nothing is read past its end. Null sizes count as 0.
    """
    import pyarrow as pa

    def apply(batches):
        run, total = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(range(len(run)), pa.int32()), pa.array(run, pa.string())], ["position", key])

        for b in batches:
            for name, n in zip(b.column("key").to_pylist(), b.column("size").to_pylist()):
                if total + n <= target:
                    run.append(name)
                    total += n
                elif len(run) >= least:
                    yield out()
                    return
                else:
                    run, total = ([name], n) if n <= target else ([], 0)
        if len(run) >= least:
            yield out()

    d = index.select("low", F.col(key).cast("string").alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    return d.repartition(1).sortWithinPartitions("low", "key").mapInArrow(apply, f"position int, {key} string")


def expired(index: DataFrame, oldest_ms: int) -> DataFrame:
    """Segments that end before a time: to be moved to the trash."""
    return index.where(F.substring("high", 1, 10) < U.encode_ms(oldest_ms))


def purgeable(index: DataFrame, before_ms: int, moved: str = "trashed_ms") -> DataFrame:
    """Trashed segments that were moved there before a time: to be deleted."""
    return index.where((F.col("state") == "trashed") & (F.col(moved) < before_ms))


def human_size(size: Column) -> Column:
    """Bytes as text in whole GB, MB or kB."""
    unit = lambda n, name: F.concat(F.floor(size / n).cast("bigint").cast("string"), F.lit(f" {name}"))
    return F.when(size > 10**9, unit(10**9, "GB")).when(size > 10**6, unit(10**6, "MB")).when(size > 10**3, unit(10**3, "kB")).otherwise(F.concat(size.cast("string"), F.lit(" Bytes")))

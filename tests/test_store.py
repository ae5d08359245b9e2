import os

import pytest

from pyspark.sql import functions as F
from tidelog.functions import ulid as U
from tidelog.operators.search import LogQuery
from tidelog.operators.store import LogStore
from tidelog.plans import stores
from tidelog.sources import files


def u(ms):
    return U.encode_ms(ms) + "0" * 16


ALL = LogQuery(u(0), u(10**9))


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


def put(store, name, records):
    with open(f"{store.root}/{name}", "w", newline="") as f:
        f.write("".join(f"{x} {b}\n" for x, b in records))


def segment(store, ms, state="flushed", body="t {}", tag=""):
    put(store, f"{u(ms[0])}-{u(ms[-1])}.{state}{tag}", [(u(k), body.format(k)) for k in ms])


def names(store):
    return sorted(x for x in os.listdir(store.root) if not x.endswith(".crc") and x != "_trash")


def bodies(df):
    return [r.body for r in df.collect()]


def test_states_decide_what_is_read(store):
    for k, s in enumerate(["flushed", "reading", "trashed", "active"]):
        segment(store, [k], s)
    put(store, f"{u(9)}-xxx.flushed", [(u(9), "t bad")])
    assert bodies(store.query(ALL)) == ["t 0", "t 1"]
    assert [os.path.basename(r.path) for r in store.quarantined().collect()] == [f"{u(9)}-xxx.flushed"] and len(names(store)) == 5
    r = store.state_stats().first()
    assert (r.flushed_segments, r.reading_segments, r.trashed_segments, r.active_segments) == (1, 1, 1, 1)


def test_files_out_of_range_are_not_opened(store, spark):
    for k in range(10):
        segment(store, [k * 100, k * 100 + 99])
    q = LogQuery(u(250), u(399))
    d = store.query(q)
    assert bodies(d) == ["t 299", "t 300", "t 399"]
    assert tuple(store.stats(q).first()) == (2, sum(os.path.getsize(f"{store.root}/{n}") for n in names(store)[2:4]))
    read = files.read(spark, store.folder, U.low_of(u(250)), U.high_of(u(399)))
    read.collect()
    scan = read._jdf.queryExecution().executedPlan()
    leaves = scan.collectLeaves()
    assert leaves.apply(0).metrics().apply("numFiles").value() == 2
    # the last millisecond counts whole, also where a file begins in it
    put(store, f"{U.encode_ms(399)}{'Z' * 16}-{u(400)}.flushed", [(U.encode_ms(399) + "Z" * 16, "t late"), (u(400), "t 400")])
    assert bodies(store.query(q))[-1] == "t late"


def test_copies_and_bad_lines(store):
    segment(store, [1, 2, 3], body="first {}")
    segment(store, [2, 4], body="second {}")
    with open(f"{store.root}/{u(5)}-{u(6)}.flushed", "w", newline="") as f:
        f.write(f"short\n\n{u(5)} a\rb\n{u(6)} last")
    assert bodies(store.query(ALL)) == ["first 1", "first 2", "first 3", "second 4", "a\rb", "last"]


def test_append_and_view(store, spark):
    d = spark.range(500).selectExpr("id as k").withColumn("ulid", U.ulid_of(F.col("k")))
    d = d.selectExpr("ulid", "concat(ulid, ' t ', cast(k as string)) as raw")
    n = store.append(d.union(d.limit(100)), target=2000)
    assert n == len(names(store)) > 5 and store.index().agg({"size_bytes": "max"}).first()[0] < 2100
    assert len(bodies(store.query(ALL))) == 500
    store.view("lines_of_store")
    assert spark.sql("select count(*) as n from lines_of_store where topic = 't' and payload = '7'").first().n == 1


def test_compaction_keeps_everything_once(store):
    segment(store, [10, 20, 30])
    segment(store, [15, 20, 25])
    segment(store, [30, 40])
    segment(store, [1000])
    before = bodies(store.query(ALL))
    picked = store.overlapping()
    assert len(picked) == 3
    assert store.compact(picked, target=10**9) == len(names(store)) - 1
    assert bodies(store.query(ALL)) == before and all(n.endswith(".flushed") for n in names(store))
    assert store.overlapping() == []
    assert len(store.sequential(10**6)) == len(names(store))
    store.compact(store.sequential(10**6))
    assert bodies(store.query(ALL)) == before


@pytest.mark.parametrize("target", [1, 40, 100, 333, 10**6])
@pytest.mark.parametrize("starts", [None, [7], [0, 3, 4, 33, 50]])
def test_files_end_at_the_target_and_before_a_start(spark, tmp_path, target, starts):
    ids = sorted([*range(0, 40), *range(0, 40, 3)])
    rows = [(u(k), n % 2, f"{u(k)} t {'ä' * (k % 5)} {n % 2}") for n, k in enumerate(ids)]
    d = spark.createDataFrame(rows, "ulid string, src int, raw string").coalesce(1)
    want, size = [], target
    for k in range(40):
        line = min(r for r in rows if r[0] == u(k))[2]
        if size >= target or k in (starts or []):
            want, size = [*want, []], 0
        want[-1].append(line)
        size += len(line.encode()) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        parts = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        files.write(d, f"file://{tmp_path}", target, starts=[u(k) for k in starts] if starts else None).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {n: open(f"{tmp_path}/{n}", newline="", encoding="utf-8").read() for n in sorted(os.listdir(tmp_path)) if n.endswith(".flushed")}
    assert got == {f"{x[0][:26]}-{x[-1][:26]}.flushed": "".join(f"{y}\n" for y in x) for x in want}


def test_all_that_overlaps_is_compacted_in_one_turn(store):
    for k in range(30):
        segment(store, [k * 10, k * 10 + 5, k * 10 + 15], body="a {}" if k % 2 else "b {}")  # a chain: each overlaps the next
    segment(store, [1000, 1001])  # alone, between two islands that would be one file
    segment(store, [2000, 2002])
    segment(store, [2001, 2002])  # a pair with one record in common
    before = bodies(store.query(ALL))
    assert store.compact_overlapping(target=10**9) == 2
    assert names(store) == sorted([f"{u(0)}-{u(305)}.flushed", f"{u(1000)}-{u(1001)}.flushed", f"{u(2000)}-{u(2002)}.flushed"])
    assert bodies(store.query(ALL)) == before == [x[27:] for n in names(store) for x in lines_of(store)[n]]
    assert store.compact_overlapping(target=10**9) == 0 and store.overlapping(2) == []


def test_a_turn_leaves_what_it_did_not_claim(store, spark, monkeypatch):
    segment(store, [1, 2])
    segment(store, [2, 3])
    segment(store, [2, 9], "reading")  # of a crash
    put(store, "no name.reading", [(u(5), "t no")])
    before = lines_of(store)
    with monkeypatch.context() as m:
        m.setattr(store, "append", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.compact_overlapping()
    assert lines_of(store) == before
    assert store.compact_overlapping() == 1
    rest = {k: v for k, v in before.items() if k.endswith(".reading")}
    assert lines_of(store) == rest | {f"{u(1)}-{u(3)}.flushed": [f"{u(k)} t {k}" for k in (1, 2, 3)]}


def test_turns_do_not_grow_with_the_segments(spark, monkeypatch, tmp_path):
    """The folder is listed once a turn; the last one finds nothing."""
    listed, count = LogStore.index, []
    monkeypatch.setattr(LogStore, "index", lambda self: count.append(1) or listed(self))
    monkeypatch.setattr(stores, "SEGMENT_BYTES", 1 << 10)
    events = spark.range(600).selectExpr("id as event_id", "timestamp_millis(id * 7919 % 600) as ts", "'view' as event_type", "'{}' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    d = stores.store_compact(spark, f"{tmp_path}")
    assert len(count) <= 3
    assert sorted((r.n, r.n_bad) for r in d.collect()) == [(1, 0)] * 600


def test_failed_compaction_puts_back(store, monkeypatch):
    segment(store, [1, 2])
    segment(store, [3, 4])
    monkeypatch.setattr(store, "append", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.compact([r.path for r in store.index().collect()])
    assert len(names(store)) == 2 and all(n.endswith(".flushed") for n in names(store))


def test_retention(store):
    segment(store, [1, 2])
    segment(store, [3, 900])
    assert store.trash(now_ms=1000, retain_ms=500) == 1 and bodies(store.query(ALL)) == ["t 3", "t 900"]
    assert store.purge(now_ms=1000) == 0
    assert store.purge(now_ms=1500, purge_ms=501) == 0 and store.purge(now_ms=1502, purge_ms=501) == 1 and len(names(store)) == 1
    assert bodies(store.query(ALL)) == ["t 3", "t 900"]


def lines_of(store):
    return {n: open(f"{store.root}/{n}", newline="").read().splitlines() for n in names(store)}


def test_recovery(store):
    put(store, "17-2-ab.active", [(u(40), "t a"), (u(30), "t b")])
    with open(f"{store.root}/17-3-cd.active", "w", newline="") as f:
        f.write(f"{u(50)} t whole\n{u(60)} t cut o")
    with open(f"{store.root}/empty.active", "w"):
        pass
    segment(store, [1, 2], "reading")
    segment(store, [3, 4], "flushed")
    segment(store, [5, 6], "trashed")
    segment(store, [7, 8], "pending")
    put(store, "X.ignored", [(u(1), "x")])
    assert store.recover() == 4
    assert names(store) == sorted(["empty.active", f"{u(30)}-{u(40)}.flushed", f"{u(50)}-{u(50)}.flushed", f"{u(1)}-{u(2)}.flushed", f"{u(3)}-{u(4)}.flushed", f"{u(5)}-{u(6)}.trashed", f"{u(7)}-{u(8)}.flushed", "X.ignored"])
    assert bodies(store.query(ALL)) == ["t 1", "t 2", "t 3", "t 4", "t 7", "t 8", "t b", "t a", "t whole"]


def rows_of(spark, ids, body="t {}"):
    return spark.createDataFrame([(u(k), f"{u(k)} {body.format(k)}") for k in ids], "ulid string, raw string").coalesce(1)


def test_two_appends_of_one_range_lose_nothing(store, spark):
    store.append(rows_of(spark, [1, 2, 9]))
    store.append(rows_of(spark, [1, 5, 9], "t late {}"))
    assert bodies(store.query(ALL)) == ["t 1", "t 2", "t late 5", "t 9"]
    before = lines_of(store)
    store.append(rows_of(spark, [1, 5, 9], "t late {}"))  # an append that is run again
    assert lines_of(store) == before and len(before) == 1


def test_a_crash_between_output_and_input_of_a_compaction(store):
    """The output has the name of an input: what both hold stays."""
    segment(store, [1, 2, 9], "reading")
    put(store, f"{u(1)}-{u(9)}.flushed", [(u(k), f"t {k}") for k in (1, 2, 5, 9)])
    assert store.recover() == 1
    assert names(store) == [f"{u(1)}-{u(9)}.flushed"] and bodies(store.query(ALL)) == ["t 1", "t 2", "t 5", "t 9"]


def test_a_failing_task_leaves_nothing(store, spark):
    os.mkdir(f"{store.root}/{u(0)}-{u(199)}.flushed")  # its file can't get its name
    with pytest.raises(Exception, match="(?i)directory|regular file"):
        store.append(rows_of(spark, range(200)))
    assert names(store) == [f"{u(0)}-{u(199)}.flushed"]


def test_what_a_killed_task_leaves_is_recovered(store, spark):
    """The writer's own temporary file, as it is in the middle of a task."""
    put(store, "3-7-0a1b.active", [(u(k), f"t {k}") for k in range(20, 30)])
    assert bodies(store.query(ALL)) == [] and store.quarantined().count() == 0
    assert store.recover() == 1 and len(bodies(store.query(ALL))) == 10
    store.append(rows_of(spark, range(20, 40)))  # the task's second attempt
    assert bodies(store.query(ALL)) == [f"t {k}" for k in range(20, 40)]


def test_claims(store):
    segment(store, [5, 6])
    os.utime(f"{store.root}/{names(store)[0]}", (1, 1))
    segment(store, [1, 2])
    top = store.claim()
    assert top.endswith(f"{u(5)}-{u(6)}.pending") and bodies(store.query(ALL)) == ["t 1", "t 2"]
    store.release(top)
    assert len(bodies(store.query(ALL))) == 4
    store.commit(store.claim())
    assert bodies(store.query(ALL)) == ["t 1", "t 2"]
    store.commit(store.claim())
    assert store.claim() is None


def test_turns(store):
    segment(store, [1, 2])
    segment(store, [3, 4])
    assert [store.run_once(10, 10**6)[0] for _ in range(5)] == ["overlapping", "sequential", "trash", "purge", "overlapping"]
    assert len(names(store)) == 1
    assert bodies(store.query(ALL)) == ["t 1", "t 2", "t 3", "t 4"]

import random

import pytest

from tidelog.functions import ulid as U
from tidelog.operators import dedup
from tidelog.operators.search import LogQuery
from tidelog.operators.store import LogStore
from tidelog.streaming import ingest as SI
from tidelog.streaming import tail as TL

T0 = 1_700_000_000_000


def u(ms):
    return U.encode_ms(ms) + "0" * 16


def stream_of(spark, folder, batches, schema="ulid string, body string, arrival bigint"):
    """A stream that takes one file a batch, in order."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.iterdir():
            if f.suffix == ".parquet" and not f.name.startswith("b"):
                f.rename(folder / f"b{k:03d}.parquet")
                os.utime(folder / f"b{k:03d}.parquet", (time.time() - 1000 + k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("pathGlobFilter", "b*.parquet").parquet(str(folder))


def collect(stream, tmp_path, **trigger):
    got = []
    q = TL.in_order(stream, lambda d, n: got.extend((r.ulid, r.body) for r in d.collect()), f"file://{tmp_path}/check", **(trigger or {"availableNow": True}))
    q.awaitTermination(180)
    assert q.exception() is None
    return got


@pytest.mark.parametrize("seed", range(2))
def test_last_wins_by_event_time(spark, tmp_path, seed):
    """Random copies in random order, against a dict; what the window has passed comes out once, in order."""
    rng = random.Random(seed)
    rows = [(u(T0 + rng.randrange(3000)), f"line {n}", n) for n in range(400)]
    rows += [(x, f"again {n}", 1000 + n) for n, (x, _, _) in enumerate(rng.sample(rows, 300))]
    rng.shuffle(rows)
    last = {x: b for x, b, _ in sorted(rows, key=lambda r: r[2])}
    s = stream_of(spark, tmp_path / "in", [rows, [(u(T0 + 60_000), "end", 9999)], [(u(T0 + 60_001), "end", 10000)]])
    assert collect(TL.tail(s, LogQuery(q=""), "1s", event_time=True), tmp_path) == sorted(last.items())


def test_filter_and_distinct(spark, tmp_path):
    rows = [(u(T0 + k), f"{'foo' if k % 2 else 'bar'} {k}", k) for k in range(10)] * 2
    s = stream_of(spark, tmp_path / "in", [rows])
    from tidelog.operators.search import matches

    got = collect(TL.distinct_stream(s.where(matches(LogQuery(q="foo"), s.body))).select("ulid", "body"), tmp_path)
    assert got == [(u(T0 + k), f"foo {k}") for k in (1, 3, 5, 7, 9)]


@pytest.mark.parametrize("text, ms", [("5s", 5000), ("50ms", 100), ("-1s", 100), ("nonsense", 3000), (None, 3000)])
def test_window(text, ms):
    assert TL.window_of(text).total_seconds() * 1000 == ms


def test_registry(spark):
    r = TL.Registry()
    r.register("plain", LogQuery(q="disk"))
    r.register("pattern", LogQuery(q="^w.rn .*[0-9]$", is_regex=True))
    lines = ["warn disk 91", "warn fan 7", "info disk", "info", None]
    d = spark.createDataFrame([(x,) for x in lines], "body string")
    want = [("pattern", x) for x in lines[:2]] + [("plain", x) for x in (lines[0], lines[2])]
    assert sorted((x.query, x.body) for x in r.match(d).collect()) == sorted(want)
    r.deregister("plain")
    assert {x.query for x in r.match(d).collect()} == {"pattern"}
    r.close()
    assert r.match(d).count() == 0
    with pytest.raises(RuntimeError):
        r.register("x", LogQuery())


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("web get /a\nw~b get /b\napi put 7\n\nlonely\nweb get /c\n")
    store = LogStore(spark, f"file://{tmp_path}/store")
    q = SI.ingest_lines(SI.file_lines(spark, f"file://{tmp_path}/in"), store, f"file://{tmp_path}/check", f"file://{tmp_path}/bad", now_ms=lambda n: T0 + n, availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = store.query(LogQuery(u(T0), u(T0 + 10))).collect()
    assert [r.body for r in got] == ["web get /a", "api put 7", "web get /c"]
    assert sorted(r.value for r in spark.read.parquet(f"file://{tmp_path}/bad").collect()) == ["", "lonely", "w~b get /b"]


def test_deduplicated_stream(spark, tmp_path):
    schema = "ulid string, src int, row_id bigint"
    rng = random.Random(4)
    rows = [(u(rng.randrange(50)), rng.randrange(3), k) for k in range(300)]
    s = stream_of(spark, tmp_path / "in", [rows[:100], rows[100:200], rows[200:]], schema)
    index = dedup.DedupIndex(spark, f"file://{tmp_path}/index", 4)
    q = SI.deduplicated(s, index, f"file://{tmp_path}/out", f"file://{tmp_path}/check", availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    best = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        best.setdefault(r[0], r[2])
    assert {r.row_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {r[2] for r in rows} - set(best.values())


def test_by_processing_time_a_late_line_comes_again(spark, tmp_path):
    import time

    a, b = u(T0), u(T0 + 5)
    s = stream_of(spark, tmp_path / "in", [[(b, "B", 1), (a, "old", 0), (a, "A", 2)], [(a, "late", 3)]])
    got = []
    q = TL.in_order(TL.tail(s, window="100ms"), lambda d, n: got.extend((r.ulid, r.body) for r in d.collect()), f"file://{tmp_path}/check", processingTime="500 milliseconds")
    end = time.time() + 90
    while len(got) < 2 and time.time() < end and q.exception() is None:
        time.sleep(0.5)
    time.sleep(4)
    q.stop()
    # the late line may come before the timer of the first has fired, and then takes its place
    assert got in ([(a, "A"), (b, "B"), (a, "late")], [(a, "late"), (b, "B")])


def test_last_of():
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(f"u{rng.randrange(20)}", f"b{k}", rng.randrange(5), k) for k in range(200)]
    best = {}
    for u_, b, a, k in rows:
        if u_ not in best or (a, k) >= best[u_][1]:
            best[u_] = (b, (a, k))
    t = TL.last_of(pa.table({"ulid": [r[0] for r in rows], "body": [r[1] for r in rows], "arrival": [r[2] for r in rows], "due": [0] * 200}))
    assert dict(zip(t["ulid"].to_pylist(), t["body"].to_pylist())) == {k: v[0] for k, v in best.items()} and len(t) == len(best)


def test_a_tail_starts_at_now_and_metrics(spark, tmp_path):
    """Segments that are there before it are not shown; those that come later are, also after a restart."""
    import os
    import time

    from tidelog.streaming.metrics import Metrics

    store = LogStore(spark, f"file://{tmp_path}/store")
    add = lambda k: store.append(spark.createDataFrame([(u(T0 + k), f"{u(T0 + k)} t {k}")], "ulid string, raw string"))
    add(1)
    for f in (tmp_path / "store").iterdir():
        os.utime(f, (time.time() - 100,) * 2)
    seen, got = Metrics().add_to(spark), []
    for k in (2, 3):
        records = TL.new_segments(spark, store.folder, f"file://{tmp_path}/check")
        time.sleep(1.1)
        add(k)
        q = TL.in_order(records, lambda d, n: got.extend(r.body for r in d.collect()), f"file://{tmp_path}/check", availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert got == ["t 2", "t 3"]
    time.sleep(1)
    spark.streams.removeListener(seen)
    assert "tidelog_batches" in seen.text() and sum(n for (_, w), n in seen.counts.items() if w == "records") >= 2


def test_durable_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("one\ntwo\n")
    store = LogStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # started again: nothing comes twice
        q = SI.ingest_lines(SI.file_lines(spark, f"file://{tmp_path}/in"), store, f"file://{tmp_path}/check", f"file://{tmp_path}/bad", "x", mode="durable", availableNow=True)
        q.awaitTermination(180)
        assert q.exception() is None
    assert sorted(r.body for r in store.query(LogQuery("2020-01-01T00:00:00Z", "2100-01-01T00:00:00Z")).collect()) == ["x one", "x two"]
    with pytest.raises(ValueError):
        SI.ingest_lines(SI.file_lines(spark, f"file://{tmp_path}/in"), store, f"file://{tmp_path}/c", f"file://{tmp_path}/bad", mode="slow")


@pytest.fixture
def default_state(spark):
    """The session with Spark's default state store, as one that nobody has set up has it."""
    was = spark.conf.get(TL.PROVIDER)
    spark.conf.set(TL.PROVIDER, TL.DEFAULT_STATE)
    yield
    spark.conf.set(TL.PROVIDER, was)


def test_a_tail_runs_on_the_default_state_store(spark, tmp_path, default_state):
    rows = [(u(T0 + k), f"line {k}", k) for k in range(5)] + [(u(T0), "again", 9), (u(T0 + 60_000), "end", 10)]
    got = collect(TL.tail(stream_of(spark, tmp_path / "in", [rows]), window="1s", event_time=True), tmp_path)
    assert got == [(u(T0), "again")] + [(u(T0 + k), f"line {k}") for k in range(1, 5)]
    assert spark.conf.get(TL.PROVIDER) == TL.DEFAULT_STATE


def test_stream_tail_is_its_sql_on_the_watermark_and_with_nulls(spark, tmp_path, default_state):
    """Lines at, beside and before the last that the window has passed, however they share shards; events without a type, props or time."""
    import datetime as dt

    import duckdb

    from tidelog.plans import logs

    at = lambda ms: dt.datetime(2024, 1, 5, 12) + dt.timedelta(milliseconds=ms)
    times = [k for k in (-9, -2, -1, 0, 1) for _ in range(12)] + [3_600_000]
    rows = [(k, at(ms), "error", f"x {k}") for k, ms in enumerate(times)]
    rows += [(100, at(-5), "error", None), (101, at(-5), None, "error"), (102, None, "error", "x"), (103, at(9_000_000), "view", "x"), (104, at(9_000_000), "error", None)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(logs.SQL["stream_tail"]).fetchall())
    assert len(want) == 36
    assert sorted(map(tuple, logs.stream_tail(spark, str(tmp_path)).collect())) == want

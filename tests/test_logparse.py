import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tidelog.operators import logparse as P

AT = 1_639_271_600_000  # 2021-12-12T01:13:20Z
CASES = [
    ("<51>1 2021-12-12T01:10:12.598586Z h12 berth-agent 1197 ID57 - gate 6 opened", 1639271412598, "ERROR", "berth-agent", "gate 6 opened"),
    ('<67>1 2021-12-12T01:10:12Z h lockkeeper 17067 ID24 [meta@0 seq="637" kind="a\\]b"][x@1] gate 7', 1639271412000, "ERROR", "lockkeeper", "gate 7"),
    ("<86>Dec 12 01:10:03 h30 lockkeeper[12272]: rolled at 40326", 1639271403000, "INFO", "lockkeeper", "rolled at 40326"),
    ("<0>Dec 31 01:10:03 h30 cron: x", 1609377003000, "FATAL", "cron", "x"),
    ('{"level":30,"time":1639271645647,"pid":631,"name":"uploader","msg":"rate \\"x\\""}', 1639271645647, "INFO", "uploader", 'rate \\"x\\"'),
    ('{"@timestamp": "2021-12-08T23:08:03.8359Z", "severity": "CRITICAL", "component": "http.client", "message": "level: ERROR"}', 1639004883835, "FATAL", "http.client", "level: ERROR"),
    ('{"log":{"level":"Information","logger":"db"},"message":"m","ts":1639402810044} (again)', 1639402810044, "INFO", "db", "m"),
    ("12.12.2021 03:18:43,136 [pool-4-thread-2] INFO  Dispatcher - rebalanced", 1639279123136, "INFO", "Dispatcher", "rebalanced"),
    ("2021-12-12T06:42:59.294+05:30 WARNING [http.client] checkpoint", 1639271579294, "WARN", "http.client", "checkpoint"),
    ("2021-12-12T01:32:05.651149Z  INFO wal::segment::roll: nothing to do", 1639272725651, "INFO", "wal::segment::roll", "nothing to do"),
    ("2021-12-12 04:29:19,059 - core.session - ERROR - a - b", 1639283359059, "ERROR", "core.session", "a - b"),
    ("[2021/12/12 04:29:30] (uploader) notice: rate", 1639283370000, "INFO", "uploader", "rate"),
    ("2021-12-12 14:20:30 | h26 | retrying <5> of 7 <WRN> @c.o.Keeper  ", 1639318830000, "WARN", "c.o.Keeper", "retrying <5> of 7"),
    ("1639281056.779 F scheduler| cannot", 1639281056779, "FATAL", "scheduler", "cannot"),
    ("I1212 01:10:32.193962  5990 rotate.go:164] slow", 1639271432193, "INFO", "rotate.go", "slow"),
    ('10.92.180.189 - - [01/Jan/2022:02:34:08 +0530] "GET / HTTP/1.1" 200 9', 1640984648000, "", "", '"GET / HTTP/1.1" 200 9'),
    ('ts=2021-12-12T13:51:06.004Z lvl=panic caller=store/lease.go:281 component=keeper msg="rate"', 1639317066004, "FATAL", "keeper", "rate"),
    ('msg="level=ERROR ts=1" caller=store/main.cc:7 level=dbg time=2021-12-12T13:51:06+01:00', 1639313466000, "DEBUG", "store/main.cc", "level=ERROR ts=1"),
]
CONTINUED = ["", " ", "\tat c.o.Pump.run(Pump.java:93)", "Traceback (most recent call last):", '  File "/srv/app/x.py", line 1, in y', "Caused by: java.io.IOException: ERROR 759 on quartz", "{", '  "level": "low"', "}", "  2021-12-12 04:29:32 first attempt, WARN", "SELECT a, count(*)", " WHERE id = 374", "goroutine 13 [running]:", "--> see note 2", "KeyError: 93", "see 2021-12-12T01:32:05Z", '{"a": 1}', '{"time": ', "<999>1 x", "[x]", "a=b c=d", '"', "\\", "é\x00ü", "I1332 01:10:32.193962  5990 rotate.go:164] month 13"]


@pytest.mark.parametrize("line, ts, level, component, message", CASES)
def test_grammars(line, ts, level, component, message):
    assert P.parse_lines(pa.array([line]), pa.array([AT])).to_pylist() == [{"ts_ms": ts, "log_level": level, "component": component, "message": message}]


UNKNOWN = [  # layouts of no table: a time near the beginning, and what is marked as level or component
    ("2021-12-12T01:13:20Z starting up", AT, "", "", "starting up"),
    ("2021-12-12 01:13:20 starting up", AT, "", "", "starting up"),
    ("Dec 12 01:13:20 host app[12]: msg", AT, "", "app", "msg"),
    ("[2021-12-12T01:13:20Z] INFO ok", AT, "INFO", "", "ok"),
    ("INFO 2021-12-12 01:13:20 ok", AT, "INFO", "", "ok"),
    ("[ERROR] 2021-12-12 01:13:20,000 [db.pool] lost", AT, "ERROR", "db.pool", "lost"),
    ("[2021-12-12 01:13:20] [warning] [core:error] [pid 35] gone", AT, "WARN", "core:error", "[pid 35] gone"),
    ("2021-12-12 02:13:20 +0100 worker.7: retry", AT, "", "worker.7", "retry"),
    ("2021-12-12T01:13:20.000Z host cron[77]: WARN: late", AT, "WARN", "cron", "late"),
    ("Dec 12 01:13:20 2021 - NOTICE - x", AT, "INFO", "", "x"),
    ("2021/12/12 01:13:20 main.go:17: listening", AT, "", "main.go", "listening"),
    ("2021-12-12T01:13:20Z I went fine", AT, "", "", "I went fine"),
]


@pytest.mark.parametrize("line, ts, level, component, message", UNKNOWN)
def test_unknown_layouts(line, ts, level, component, message):
    assert P.parse_lines(pa.array([line]), pa.array([AT])).to_pylist() == [{"ts_ms": ts, "log_level": level, "component": component, "message": message}]


@pytest.mark.parametrize("seed", range(3))
def test_layouts_made_at_random(seed):
    """Times, levels and components in forms and orders drawn at random; what was drawn must come out."""
    import datetime as dt

    rng = random.Random(seed)
    lines, want = [], []
    for _ in range(500):
        at = AT - rng.randrange(10**9) * 1000 - rng.randrange(1000)
        t = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=at)
        form = rng.choice(["%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "[%Y-%m-%d %H:%M:%S,%f]", "%d.%m.%Y %H:%M:%S"])
        whole = at if "%f" in form else at // 1000 * 1000
        name, level = rng.choice([("error", "ERROR"), ("WARN", "WARN"), ("Fatal", "FATAL"), ("DEBUG", "DEBUG"), (None, "")])
        component = rng.choice(["db", "a.b.C", "net-io", ""])
        marks = []
        if name:
            marks.append(rng.choice([f"[{name}]", f"<{name}>", name.upper(), f"{name}:"]))
        if component:
            marks.append(rng.choice([f"[{component}]", f"({component})"]))
        rng.shuffle(marks)
        sep = rng.choice([" ", " - ", " | "])
        front = []
        if name and rng.random() < 0.3:  # the level before the time
            marks = [m for m in marks if name.lower() not in m.lower()]
            front = [rng.choice([f"[{name}]", name.upper()])]
        lines.append(" ".join(front + [sep.join([t.strftime(form), *marks, "it is done at 5"])]))
        want.append({"ts_ms": whole, "log_level": level, "component": component, "message": "it is done at 5"})
    assert P.parse_lines(pa.array(lines), pa.array([AT] * len(lines))).to_pylist() == want


def test_lookahead_leaves_out_no_entry():
    """Lines that the lookahead calls continuations fit no grammar either."""
    rng = random.Random(7)
    parts = ["INFO", "[", "]", "2021-12-12", "01:13:20", "x", ":", '"q r"', "=", "{", "}", "<13>", "Dec", "12", "-", "|", "ts=1639271600.5", "10.0.0.1", "(main)", "\t"]
    lines = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(4000)]
    got = P.parse_lines(pa.array(lines), pa.array([AT] * len(lines))).to_pylist()
    look, P.may_begin = P.may_begin, lambda first, kinds: np.diff(first) > 0
    try:
        assert got == P.parse_lines(pa.array(lines), pa.array([AT] * len(lines))).to_pylist()
    finally:
        P.may_begin = look
    assert any(got) and not all(got)


@pytest.mark.parametrize("line", CONTINUED)
def test_continuations(line):
    assert P.parse_lines(pa.array([line]), pa.array([AT])).to_pylist() == [None]


def test_no_year():
    got = lambda line, at: P.parse_lines(pa.array([line]), pa.array([at])).to_pylist()[0]["ts_ms"]
    assert got("<13>Dec 12 01:13:20 h x: y", AT) == AT
    assert got("<13>Dec 12 01:13:21 h x: y", AT) == AT + 1000 - 365 * 86_400_000
    assert got("<13>Feb 29 00:00:00 h x: y", AT) == 1_582_934_400_000


def test_batches_with_nulls_and_long_lines():
    lines = [c[0] for c in CASES] + CONTINUED + [None, "x" * 300_000, CASES[0][0] + "y" * 100_000]
    random.Random(1).shuffle(lines)
    whole = P.parse_lines(pa.array(lines), pa.array([AT] * len(lines))).to_pylist()
    assert whole == [P.parse_lines(pa.array([x], pa.string()), pa.array([AT])).to_pylist()[0] for x in lines]
    assert P.parse_lines(pa.array([], pa.string()), pa.array([], pa.int64())).to_pylist() == []


def test_any_text_is_a_token_or_gap():
    rng = random.Random(2)
    for _ in range(300):
        s = "".join(rng.choice('ab1 "\\:-./+,=|[]{}()<>@TZ\té') for _ in range(rng.randrange(40))).encode()
        for _, first, _, b, e in P.tokenise(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)])):
            assert first[-1] == len(b) == len(e)
            at = 0
            for x, y in zip(b.tolist(), e.tolist()):
                assert s[at:x].strip() == b"" and x < y
                at = y
            assert s[at:].strip() == b""


def brute(rows):
    out, last = [], {}
    for conn, topic, u, ms, start in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if start:
            last[conn, topic] = [conn, topic, u, start, 1]
            out.append(last[conn, topic])
        elif (conn, topic) in last:
            last[conn, topic][4] += 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("shard_ms", [5, 100, 10**9])
def test_entries(spark, shard_ms):
    rng = random.Random(shard_ms)
    rows = []
    for k in range(2000):
        conn = rng.choice([1, 1, 1, 2, None])
        rows.append((conn, rng.choice("ab"), f"{k:06d}", k // 3, rng.randrange(1, 9) if rng.random() < 0.15 else None))
    d = spark.createDataFrame(rows, "conn int, topic string, u string, ms bigint, x int").withColumn("entry", F.when(F.col("x").isNotNull(), F.struct("x")))
    got = [(r.conn, r.topic, r.u, r.x, r.n_lines) for r in P.entries(d, ("conn", "topic"), "u", "ms", shard_ms).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert P.entries(d.where("false"), ("conn", "topic"), "u", "ms").count() == 0


@pytest.mark.parametrize("shard_ms", [5, 100, 10**9])
def test_messages_go_on_with_their_continuations(spark, shard_ms):
    rng = random.Random(shard_ms)
    rows, want, last = [], {}, {}
    for k in range(600):
        conn, start = rng.choice([1, 1, 2, None]), rng.random() < 0.1
        text = rng.choice(["", "two words", "  x", None]) if not start else f"first {k}"
        rows.append((conn, f"{k:06d}", k // 3, text if start else None, text, 1))
        if start:
            want[k] = [text]
            last[conn] = k
        elif conn in last:
            want[last[conn]].append(text or "")
    d = spark.createDataFrame(rows, "conn int, u string, ms bigint, m string, text string, n int").repartition(3).withColumn("entry", F.when(F.col("m").isNotNull(), F.struct(F.col("m").alias("message"))))
    got = {int(r.u): (r.message, r.n_lines) for r in P.entries(d, ("conn",), "u", "ms", shard_ms, text="text").collect()}
    assert got == {k: ("\n".join(v), len(v)) for k, v in want.items()}
    assert P.entries(d.where("false"), ("conn",), "u", "ms", text="text").count() == 0


def test_parsed_in_spark(spark):
    rows = [(c[0], AT, "clash") for c in CASES] + [(None, AT, "x")]
    d = P.parsed(spark.createDataFrame(rows, "body string, ulid_ms bigint, entry string"))
    assert [r.entry.ts_ms if r.entry else None for r in d.collect()] == [c[1] for c in CASES] + [None]

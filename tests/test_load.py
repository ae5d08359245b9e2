import json
import random

import pyarrow as pa
import pytest

from tidelog.operators import load as L

TOPICS = [("app", "log", None), ("m", "csv", "at:timestamp,host:word,value:decimal,note:text?"), ("n", "csv", "k:int,day:date,ok:bool"), ("j", "json", "seq:int,sku:text,price:decimal,on:bool,day:date")]
U = "01F8MECHZX0000000000000000"


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame(TOPICS, "topic string, payload string, layout string")


GOOD_J = {"seq": 1, "sku": "a \"b\"", "price": 1.5, "on": True, "day": "2020-02-29"}
CASES = [
    (f"{U} app anything \"goes\n", U, None),
    (f"{U} app \n", U, None),
    (f"{U} app x", None, None),
    (f"﻿ {U.lower()} app x\r\n", f"\t{U} ", None),
    (f"{U} app\n", U, "columns"),
    (f"{U}\n", U, "columns"),
    (f"{U}", U, "columns"),
    ("", U, "columns"),
    (None, U, "columns"),
    (f"{U} ap~p x\n", U, "value"),
    (f"{U} -app x\n", U, "value"),
    (f"{U} unknown x\n", U, None),
    (f"{U[:-1]} app x\n", U[:-1], "value"),
    (f"8{U[1:]} app x\n", f"8{U[1:]}", "value"),
    (f"{U} app x\n", "(none)", "value"),
    (f"{U} app x\n", "", "value"),
    (f"{U} m 2020-01-02T03:04:05Z,h1,1.5,\n", U, None),
    (f'{U} m 2020-01-02T03:04:05.123456+05:30,"h1",-.5,"a, ""b"""\r\n', U, None),
    (f"{U} m 2020-01-02T03:04:05Z,h1,1.5\n", U, "columns"),
    (f"{U} m 2020-01-02T03:04:05Z,h1,1.5,a,b\n", U, "columns"),
    (f"{U} m \n", U, "columns"),
    (f'{U} m 2020-01-02T03:04:05Z,h"1,1.5,a\n', U, "quoting"),
    (f'{U} m 2020-01-02T03:04:05Z,"h1,1.5,a\n', U, "quoting"),
    (f'{U} m "a "b" c",h1\n', "other", "quoting"),
    (f"{U} m yesterday,h1,1.5,a\n", U, "value"),
    (f"{U} m 2020-02-30T03:04:05Z,h1,1.5,a\n", U, "value"),
    (f"{U} m 2020-01-02T03:04:05,h1,1.5,a\n", U, "value"),
    (f"{U} m 2020-01-02T03:04:05Z,h 1,1.5,a\n", U, "value"),
    (f"{U} m 2020-01-02T03:04:05Z,,1.5,a\n", U, "value"),
    (f"{U} m 2020-01-02T03:04:05Z,h1,1..5,a\n", U, "value"),
    (f"{U} n 9223372036854775807,2020-01-31,true\n", U, None),
    (f"{U} n 9223372036854775808,2020-01-31,true\n", U, "value"),
    (f"{U} n 0x1F,2020-01-31,true\n", U, "value"),
    (f"{U} n  12,2020-01-31,true\n", U, "value"),
    (f"{U} n 12,2021-02-29,true\n", U, "value"),
    (f"{U} n 12,2020-01-31,TRUE\n", U, "value"),
    (f"{U} n 12,2020-01-31\n", "other", "columns"),
    (f"{U} n ,,\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J)}\n", U, None),
    (f"{U} j {json.dumps(dict(reversed(GOOD_J.items())), separators=(',', ':'))}\n", U, None),
    (f"{U} j {json.dumps(GOOD_J | {'more': 1})}\n", U, "columns"),
    (f"{U} j {json.dumps({k: v for k, v in GOOD_J.items() if k != 'on'})}\n", U, "columns"),
    (f"{U} j {json.dumps({('oN' if k == 'on' else k): v for k, v in GOOD_J.items()})}\n", U, "columns"),
    (f'{U} j {json.dumps(GOOD_J)[:-1]}, "seq": 2}}\n', U, "columns"),
    (f"{U} j [1]\n", U, "columns"),
    (f"{U} j {str(GOOD_J)}\n", U, "quoting"),
    (f"{U} j {json.dumps(GOOD_J)[:-9]}\n", U, "quoting"),
    (f"{U} j {json.dumps(GOOD_J)} x\n", U, "quoting"),
    (f"{U} j {json.dumps(GOOD_J | {'seq': '1'})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'seq': 1.5})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'seq': None})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'seq': 2**63})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'on': 'true'})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'price': '1.5'})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'sku': 5})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'day': '30th Jan'})}\n", U, "value"),
    (f"{U} j {json.dumps(GOOD_J | {'price': 3})}\n", U, None),
]


def test_cases(spark, topics):
    rows = [(k, i, r, "clash", "x") for k, (r, i, _) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "row_id bigint, id string, record string, reason string, topic string")
    got = {r.row_id: r.reason for r in L.load(d, topics).collect()}
    assert len(got) == len(CASES)
    for k, (record, _, reason) in enumerate(CASES):
        assert got[k] == reason, record
    assert {r.row_id: r.reason for r in L.rejected(d, topics).collect()} == {k: c[2] for k, c in enumerate(CASES) if c[2]}
    assert L.loaded(d, topics).count() == sum(c[2] is None for c in CASES)


def test_empty(spark, topics):
    d = spark.createDataFrame([], "row_id bigint, id string, record string")
    assert L.rejected(d, topics).count() == 0
    one = spark.createDataFrame([(1, U, f"{U} a b")] * 2, "row_id bigint, id string, record string")
    assert L.loaded(one, topics.where("false")).count() == 2


@pytest.mark.parametrize("bad_share", [0, 0.02, 0.5, 1])
def test_blocks_give_what_single_rows_give(bad_share):
    rng = random.Random(int(bad_share * 100))
    layouts = {t: (f, L.Layout(y)) for t, f, y in TOPICS if y}
    topic, payload = [], []
    for _ in range(3000):
        t = rng.choice(["m", "n", "j", "app"])
        p = {"m": "2020-01-02T03:04:05Z,h1,1.5,note", "n": "5,2020-01-31,false", "j": json.dumps(GOOD_J), "app": "x"}[t]
        if rng.random() < bad_share:
            at = rng.randrange(len(p))
            p = rng.choice([p[:at], p[:at] + rng.choice('",x{}\\ ') + p[at:], p[:at] + p[at + 1 :], p + ",1", ""])
        topic.append(t)
        payload.append(p)
    got = L.payload_reasons(pa.array(topic), pa.array(payload), layouts).to_pylist()
    for t, p, g in zip(topic, payload, got):
        want = None if t == "app" else L.diagnose(p, *layouts[t])
        assert g == want, (t, p)


def test_bisect_isolates():
    block = pa.array([str(k) for k in range(1000)])
    calls = []

    def good(b):
        calls.append(len(b))
        return not any(int(x) in (3, 500, 501, 999) for x in b.to_pylist())

    assert L.bisect(block, good, lambda x: "value" if int(x) in (3, 500, 501, 999) else None) == {3: "value", 500: "value", 501: "value", 999: "value"}
    assert len(calls) < 60


def test_too_many_topics(spark, monkeypatch, topics):
    monkeypatch.setattr(L, "MAX_TOPICS", 2)
    with pytest.raises(ValueError):
        L.read_layouts(topics)


@pytest.mark.parametrize("seed", range(6))
def test_optional_keys_in_blocks(seed):
    """Keys that lack, come twice, or look like text: in a block each row is what it is alone."""
    rng = random.Random(seed)
    layout = L.Layout("a:int,b:text?,c:decimal?")
    values = {"a": ["1", "null", "7"], "b": ['"x"', "null", '""', r'"x\":y"', r'"\"b\":1"', r'"\\"', '"a"', r'"\u0022c\u0022:"'], "c": ["1.50", "null", "-3e2", "12345678901234567890.1"]}
    rows = []
    for _ in range(400):
        keys = rng.choice(["abc", "abc", "abc", "cba", "ab", "ac", "a", "aabc", "aab", "abbc", "abd"])
        pair = [f'"{k}"{rng.choice([":", ":", ": ", " :"])}{rng.choice(values.get(k, ["1"]))}' for k in keys]
        rows.append("{" + ",".join(pair) + "}")
    rows += [r'{"\u0061":1,"b":null,"c":null}', '{"a":1}', r'{"a":1,"b":"x\":y"}']
    reasons, columns = L.payload_columns(pa.array(rows), "json", layout)
    for k, text in enumerate(rows):
        want = L.read_json_row(text, layout)
        assert reasons[k].as_py() == (want if isinstance(want, str) else None), text
        assert [c[k].as_py() for c in columns] == ([None] * 3 if isinstance(want, str) else [v or None for v in want]), text
    assert {r.as_py() for r in reasons} >= {None, "columns", "value"}


def test_a_table_with_types(spark, topics):
    from datetime import date, datetime
    from decimal import Decimal

    d = spark.createDataFrame([(k, i, r, "clash") for k, (r, i, _) in enumerate(CASES)], "row_id bigint, id string, record string, value string")
    m = L.loaded_table(d, topics, "m")
    assert m.dtypes == [("row_id", "bigint"), ("value", "string"), ("ulid", "string"), ("at", "timestamp"), ("host", "string"), ("m.value", "decimal(38,18)"), ("note", "string")]
    rows = m.orderBy("row_id").collect()
    assert len(rows) == 2 and rows[0][3:] == (datetime(2020, 1, 2, 3, 4, 5), "h1", Decimal("1.5"), None)
    assert rows[1][3:] == (datetime(2020, 1, 1, 21, 34, 5, 123456), "h1", Decimal("-.5"), 'a, "b"')
    j = L.loaded_table(d, topics, "j").collect()
    assert len(j) == 3 and all((r.seq, r.sku, r.on, r.day) == (1, 'a "b"', True, date(2020, 2, 29)) for r in j) and {r.price for r in j} == {Decimal("1.5"), Decimal(3)}
    assert L.loaded_table(d, topics, "n").first().k == 2**63 - 1
    assert L.loaded_table(d, topics, "app").columns == ["row_id", "value", "ulid", "payload"] and L.loaded_table(d, topics, "app").count() == 4
    leap = spark.createDataFrame([(1, U, f"{U} m 2016-12-31T23:59:60Z,h,1,x")], "row_id bigint, id string, record string")
    assert L.loaded_table(leap, topics, "m").first().at == datetime(2017, 1, 1)
    assert L.loaded_table(d.where("false"), topics, "m").count() == 0

from pathlib import Path

import pyarrow as pa
import pytest

from tidelog.functions.ulid import decode_ms
from tidelog.operators import load, logparse
from tidelog.plans import records as R
from tidelog.sources.tables import table

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def loaded(spark):
    d = load.loaded(table(spark, str(DATA), "merge_records"), table(spark, str(DATA), "topics"))
    return d.select("ulid", "src", "row_id", "conn_id", "topic", "form", "body").collect()


def test_p1(spark, loaded):
    best, lost = set(), set()
    for r in sorted(loaded, key=lambda r: (r.src, r.row_id)):
        if r.ulid in best:
            lost.add(r.row_id)
        best.add(r.ulid)
    assert {r.row_id for r in R.p1_found(spark, str(DATA)).collect()} == lost


def test_p3(spark, loaded):
    kept = {}
    for r in sorted(loaded, key=lambda r: (r.src, r.row_id)):
        kept.setdefault(r.ulid, r)
    lines = sorted((r for r in kept.values() if r.form == "log"), key=lambda r: (r.conn_id, r.topic, r.ulid))
    want, last, stream = [], None, None
    for r in lines:
        # one line at a time, by the same grammars
        e = logparse.parse_lines(pa.array([r.body]), pa.array([decode_ms(r.ulid)])).to_pylist()[0]
        if (r.conn_id, r.topic) != stream:
            stream, last = (r.conn_id, r.topic), None
        if e:
            last = [r.ulid, e["ts_ms"], e["log_level"], e["component"], 1]
            want.append(last)
        elif last:
            last[4] += 1
    got = R.p3_found(spark, str(DATA))
    assert got.columns == ["id", "ts_ms", "log_level", "component", "n_lines"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and any(w[4] > 1 for w in want)
    assert {r.id for r in R.p3_entries(spark, str(DATA)).collect()} == {w[0] for w in want}


def test_p5_holds_each_file_once_within_the_target(spark):
    from tidelog.operators import compact

    rows = R.p5_plan(spark, str(DATA)).collect()
    loads = {}
    for r in rows:
        loads[r.volume, r.part, r.output] = loads.get((r.volume, r.part, r.output), 0) + r["size"]
    assert len({(r.volume, r.low, r.high) for r in rows}) == len(rows) and max(loads.values()) <= compact.TARGET

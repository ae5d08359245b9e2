import importlib.util
import re
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    d = entry.queries()[name](spark, str(DATA))
    columns = sorted(d.columns)
    got = sorted((tuple(r[c] for c in columns) for r in d.collect()), key=repr)
    result = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, str(DATA)).count() >= 0


def test_stands_without_llm(monkeypatch):
    """The rest imports without the subpackage, and nothing of the rest imports it."""
    for p in (HERE / "tidelog").rglob("*.py"):
        if "llm" not in p.relative_to(HERE / "tidelog").parts:
            assert not re.search(r"\bllm\b", p.read_text())
    monkeypatch.setitem(sys.modules, "tidelog.llm", None)
    monkeypatch.setitem(sys.modules, "tidelog.llm.plans", None)
    spec = importlib.util.spec_from_file_location("entry_alone", HERE / "__spark_entry__.py")
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert alone.llm is None and "p1_found" in alone.queries() and not any(n.startswith(("p6_", "p7_", "p8_")) for n in alone.queries())

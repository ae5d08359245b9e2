import os
import random

import pytest

from pyspark.sql import functions as F
from tidelog.operators import compact as C

SCHEMA = "volume string, low string, high string, size bigint"


@pytest.mark.parametrize("seed", range(5))
def test_schedule(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(1, 300))), reverse=True)
    groups = C.schedule(sizes, 100)
    loads = {}
    for s, g in zip(sizes, groups):
        loads[g] = loads.get(g, 0) + s
    assert max(loads.values()) <= 100 and len(loads) <= sum(sizes) / 100 * 1.3 + 1


def test_schedule_edges():
    assert C.schedule([], 10) == []
    assert sorted(C.schedule([25, 10, 0, 0], 10)) == [0, 0, 0, 1]
    assert C.schedule([0, 0], 10) == [0, 0]


def test_plan(spark):
    m = 1 << 20
    rows = [("a", str(k), "z", 5 * m) for k in range(60)] + [("a", "big", "z", 16 * m), ("a", "null", "z", None), ("one", "1", "z", 1), ("b", "1", "z", 0), ("b", "2", "z", 1), (None, "1", "z", 1), (None, "2", "z", 1)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash"))
    got = C.plan(d).collect()
    assert sorted((r.volume, r.low) for r in got) == sorted([("a", str(k)) for k in range(60)] + [("b", "1"), ("b", "2")])
    loads = {}
    for r in got:
        loads[r.volume, r.part, r.output] = loads.get((r.volume, r.part, r.output), 0) + r["size"]
    assert len(loads) == 4 and max(loads.values()) <= C.TARGET
    # a large volume is taken in parts, and still whole
    parts = C.plan(d, part_files=7).collect()
    assert len(parts) == 62 and len({r.part for r in parts if r.volume == "a"}) > 4
    assert C.plan(d.where("false")).count() == 0
    named = C.output_name(C.plan(d.withColumn("path", F.concat_ws("/", "volume", "low")), part_files=7)).collect()
    assert len({r.output for r in named}) == len({(r.volume, r.part, r.output) for r in named}) and all(r.path == f"{r.volume}/{r.low}" for r in named)


@pytest.mark.parametrize("form", ["parquet", "lines"])
def test_consolidate(spark, tmp_path, form):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, rows, want = random.Random(1), [], []
    for k in range(40):
        values = [f"{k}-{n}-é" for n in range(rng.randrange(0, 30))] + ["twice", "twice"]
        path = tmp_path / f"in-{k}"
        if form == "parquet":
            pq.write_table(pa.table({"v": values, "n": list(range(len(values)))}), path)
        else:
            path.write_text("\n".join(values) + ("\n" if k % 2 else ""))
        rows.append((f"o{k % 3}", f"file://{path}"))
        want += values
    out = tmp_path / "out"
    done = C.consolidate(spark.createDataFrame(rows, "output string, path string"), f"file://{out}", form).collect()
    assert len(done) == 3 and sum(r.n_files for r in done) == 40 and sum(r.n_rows for r in done) == len(want)
    got = []
    for r in done:
        got += pq.read_table(out / r.file)["v"].to_pylist() if form == "parquet" else (out / r.file).read_text().splitlines()
    assert sorted(got) == sorted(want)
    # a second run has a manifest of its own, and the first stands until it is complete
    first = {r.file for r in C.published(spark, f"file://{out}").collect()}
    assert first == {r.file for r in done}
    with pytest.raises(Exception):
        C.consolidate(spark.createDataFrame([("o", f"file://{tmp_path}/missing")], "output string, path string"), f"file://{out}", form)
    assert {r.file for r in C.published(spark, f"file://{out}").collect()} == first
    again = {r.file for r in C.consolidate(spark.createDataFrame(rows[:3], "output string, path string"), f"file://{out}", form).collect()}
    assert {r.file for r in C.published(spark, f"file://{out}").collect()} == again and not again & first


@pytest.mark.parametrize("form", ["parquet", "lines"])
def test_a_changed_output_is_found(tmp_path, monkeypatch, form):
    """What is read again is compared with the inputs themselves."""
    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    one, two = tmp_path / "one", tmp_path / "two"
    pq.write_table(pa.table({"v": [["a"], None, []], "n": [1.5, None, float("inf")]}), one) if form == "parquet" else one.write_text("a\nb\n")
    pq.write_table(pa.table({"v": [["a"], None, ["x"]], "n": [1.5, None, float("inf")]}), two) if form == "parquet" else two.write_text("a\nc\n")
    copy, name = (C._copy_parquet, "_batches") if form == "parquet" else (C._copy_lines, "_chunks")
    assert copy([f"file://{one}"] * 3, pafs.LocalFileSystem(), str(tmp_path / "out")) == (9 if form == "parquet" else 6)
    read, calls = getattr(C, name), []
    monkeypatch.setattr(C, name, lambda uris: calls.append(1) or read([f"file://{two}"] if len(calls) == 2 else uris))
    with pytest.raises(OSError, match="does not hold"):
        copy([f"file://{one}"], pafs.LocalFileSystem(), str(tmp_path / "out"))


def test_nothing_is_published_after_a_failure(spark, tmp_path):
    d = spark.createDataFrame([("o", f"file://{tmp_path}/missing")], "output string, path string")
    with pytest.raises(Exception):
        C.consolidate(d, f"file://{tmp_path}/out", "lines")
    assert not os.path.exists(tmp_path / "out/manifest")

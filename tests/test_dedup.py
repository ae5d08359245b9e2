import random

import pytest

from tidelog.functions import ulid as U
from tidelog.operators import dedup as D

SCHEMA = "ulid string, src int, row_id bigint"


def brute(rows):
    best, lost = {}, set()
    for u, s, r in sorted((x for x in rows if x[0] is not None), key=lambda x: (D.NO_SRC if x[1] is None else x[1], x[2])):
        if u in best:
            lost.add(r)
        else:
            best[u] = r
    return lost


def made(n, ids, seed, hot=0.0):
    rng = random.Random(seed)
    u = lambda k: U.encode_ms(k) + "0" * 16
    return [(u(0) if rng.random() < hot else u(rng.randrange(ids)), rng.choice([1, 2, 3, None]), k) for k in range(n)]


@pytest.mark.parametrize("n, ids, hot", [(0, 1, 0), (1, 1, 0), (500, 400, 0), (3000, 50, 0.34), (2000, 1, 1)])
def test_superseded(spark, n, ids, hot):
    rows = made(n, ids, n, hot)
    got = [r.row_id for r in D.superseded(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_nulls_are_no_deliveries(spark):
    rows = [(None, 1, 1), (None, 1, 2), ("0" * 26, 1, 3)]
    assert D.superseded(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_batches_one_by_one(spark, tmp_path):
    rows = made(4000, 900, 3)
    path, lost = f"file://{tmp_path}/index", set()
    for k in range(12):
        # a fresh object each time: all state is in the folder
        index = D.DedupIndex(spark, path, prefixes=4)
        part = spark.createDataFrame(rows[k * 300 : k * 300 + 300], SCHEMA)
        got = {r.row_id for r in index.add(part, k).collect()}
        assert got == {r.row_id for r in D.DedupIndex(spark, path).add(part, k).collect()}  # again: the same, and nothing is taken twice
        lost |= got
    assert lost == brute(rows[:3600])
    levels = [[level for _, level in v] for v in D.DedupIndex(spark, path).runs.values()]
    assert all(v.count(k) < D.FAN for v in levels for k in v) and any(max(v) >= 1 for v in levels)


def test_runs_are_read_back_and_merged(spark, tmp_path):
    """Of batches with identifiers that all have been seen, every run of every prefix is searched, and FAN of a level become one."""
    index = D.DedupIndex(spark, f"file://{tmp_path}/index", prefixes=2)
    ids = [U.encode_ms(k) + "0" * 16 for k in range(400)]
    seen = []
    for n in range(2 * D.FAN):
        # each batch brings its own and better copies of all before it
        rows = [(x, 10 - n % 10, 1000 * n + k) for k, x in enumerate(ids[: 40 * (n + 1)])]
        lost = {r.row_id for r in index.add(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert lost == {1000 * (n - 1) + k for k in range(40 * n)}
        seen.append(index.searched)
        names = {x for v in index.runs.values() for x, _ in v}
        assert all((tmp_path / "index" / x).exists() for x in names)
    assert seen[:D.FAN] == [0, 2, 4, 6] and seen[D.FAN] == 2  # four runs of each prefix have become one


@pytest.mark.parametrize("batches", [1, 3, 40])
def test_superseded_by_batches(spark, batches):
    rng = random.Random(batches)
    rows = [(*r, rng.choice([None, *range(batches)])) for r in made(1500, 300, 8, 0.34)]
    d = spark.createDataFrame(rows, SCHEMA + ", batch_id bigint").repartition(3)
    d = d.withColumn("epoch", D.epoch_of(d, "batch_id").cast("int"))
    assert d.select("epoch").distinct().count() == min(batches, D.EPOCHS) or batches == 3
    assert {r.row_id for r in D.superseded(d).collect()} == brute([r[:3] for r in rows])
    assert D.superseded(d.where("false")).count() == 0


def test_tags_go_with_rows(spark, tmp_path):
    rows = [(u, s, r, r * 7) for u, s, r in made(2000, 300, 5, 0.2)]
    index = D.DedupIndex(spark, f"file://{tmp_path}/index", prefixes=4)
    for part in (rows[:700], rows[700:]):
        got = [(r.row_id, r.tag) for r in index.add(spark.createDataFrame(part, SCHEMA + ", tag bigint")).collect()]
        assert got and all(t == r * 7 for r, t in got)


def test_look_up_and_merge():
    import numpy as np

    ids = lambda *x: np.array(x, "S2")
    a, lost = D.best_of(ids("b", "a", "b"), np.array([2, 1, 1]), np.array([10, 11, 12]), np.array([5, 6, 7]))
    assert a[0].tolist() == [b"a", b"b"] and a[2].tolist() == [11, 12] and [x.tolist() for x in lost] == [[10], [5]]
    run, gone = D.admit([a], ids("b", "c"), np.array([0, 5]), np.array([20, 21]), np.array([8, 9]))
    assert run[2].tolist() == [20, 21] and [x.tolist() for x in gone] == [[12], [7]]
    assert D.merge([a, run])[2].tolist() == [11, 20, 21]


def test_kept(spark):
    rows = [("a", 2, 1, "x", None), ("a", 1, 3, "y", 5), ("a", 1, 2, "z", 6), ("b", None, 1, None, None), (None, 1, 1, "n", 1)]
    d = spark.createDataFrame(rows, "ulid string, src int, row_id bigint, text string, _best int")
    assert sorted((r.ulid, r.row_id, r.text, r._best) for r in D.kept(d).collect()) == [("a", 2, "z", 6), ("b", 1, None, None)]
    assert D.kept(d.where("false")).count() == 0


@pytest.mark.parametrize("n, ids, hot", [(0, 1, 0), (800, 300, 0), (1500, 40, 0.34), (500, 1, 1)])
def test_settled(spark, n, ids, hot):
    """Rows stay with all columns; repeated rows are one; a condition leaves out rows, but they count against others."""
    rows = [(*r, r[2] % 3, "clash") for r in made(n, ids, n + 1, hot)]
    rows += rows[:50] + [(None, 1, 5, 1, "x"), ("0" * 26, 1, None, 1, "x")] * (n > 0)
    d = spark.createDataFrame(rows, SCHEMA + ", kind int, tag string").repartition(5)
    best = {}
    for r in sorted((r for r in rows if r[0] and r[2] is not None), key=lambda r: (D.NO_SRC if r[1] is None else r[1], r[2])):
        best.setdefault(r[0], r)
    assert sorted(map(tuple, D.settled(d).collect()), key=repr) == sorted(best.values(), key=repr)
    assert sorted(map(tuple, D.settled(d, "kind = 1").collect()), key=repr) == sorted((r for r in best.values() if r[3] == 1), key=repr)

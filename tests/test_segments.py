import random

import pytest

from pyspark.sql import functions as F
from tidelog.functions import ulid as U
from tidelog.operators import segments as S


def u(ms):
    return U.encode_ms(ms) + "0" * 16


def ranges(rng, n, span=1000, longest=60):
    """Random ranges in milliseconds, some of no length, some that share ends."""
    out = []
    for _ in range(n):
        a = rng.randrange(span)
        out.append((a, a + rng.choice([0, 1, rng.randrange(longest)])))
    return out


def test_overlap(spark):
    """Against shared points: all ways to lay two ranges of small whole numbers, each given either way round."""
    rows = [(a, b, c, d) for a in range(5) for b in range(5) for c in range(5) for d in range(5)]
    table = spark.createDataFrame([tuple(map(u, r)) for r in rows], "a string, b string, c string, d string")
    got = {tuple(U.decode_ms(x) for x in r[:4]): r.x for r in table.select("*", S.overlap(*map(F.col, "abcd")).alias("x")).collect()}
    assert got == {(a, b, c, d): bool(set(range(min(a, b), max(a, b) + 1)) & set(range(min(c, d), max(c, d) + 1))) for a, b, c, d in rows}


@pytest.mark.parametrize("seed", range(4))
def test_islands(spark, seed):
    """Against milliseconds painted one by one; a group of its own, a null group, repeated rows, a column of the operator's own names."""
    rng = random.Random(seed)
    rows = [(g, a, b) for g, n in (("x", 80), ("y", 1), (None, 30)) for a, b in ranges(rng, n)] + [("x", 5, 7)] * 2
    d = spark.createDataFrame([(g, u(a), u(b), 1) for g, a, b in rows], "g string, low string, high string, carry int")

    def brute(members):
        painted = [set(range(2 * a, 2 * b + 1)) for a, b in members]
        out, n, upto = {}, 0, -1
        for a, b in sorted(members):
            n += not any(2 * a in p and x <= (a, b) for p, x in zip(painted, members) if x != (a, b)) and 2 * a > upto
            upto = max(upto, 2 * b)
            out[a, b] = n
        return out

    want = {(g, *k): n for g in ("x", "y", None) for k, n in brute([(a, b) for h, a, b in rows if h == g]).items()}
    got = S.islands(d, ["g"]).collect()
    assert {(r.g, U.decode_ms(r.low), U.decode_ms(r.high)): r.island for r in got} == want and len(got) == len(rows)
    alone = {(U.decode_ms(r.low), U.decode_ms(r.high)): r.island for r in S.islands(d).collect()}
    assert alone == brute([(a, b) for _, a, b in rows])
    assert S.islands(d.where("false")).count() == 0


def in_a_row(sizes, target, least):
    """First run by trying every one: from each place where one can begin."""
    begin = 0
    while begin < len(sizes):
        end = begin
        while end < len(sizes) and sum(sizes[begin : end + 1]) <= target:
            end += 1
        if end - begin >= least:
            return list(range(begin, end))
        begin = end if end > begin else begin + 1
    return []


@pytest.mark.parametrize("seed", range(8))
def test_first_sequential(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 40, 90, 101, 500]) for _ in range([0, 1, 2, 5, 9, 20, 20, 20][seed])]
    least = rng.choice([2, 3])
    d = spark.createDataFrame([(u(k), f"p{k}", z) for k, z in enumerate(sizes)], "low string, path string, size bigint")
    got = S.first_sequential(d, "path", "size", 100, least).orderBy("position").collect()
    assert [r.path for r in got] == [f"p{k}" for k in in_a_row(sizes, 100, least)]


def test_names(spark):
    a, b = u(5), u(9)
    good = [f"/srv/x/vol-0000007/store/{a}-{b}.flushed", f"file:///srv/VOL-0000007//store/./{b.lower()}-{a.lower()}.FLUSHED ", f"srv\\vol-0000007\\{a}-{b}.flushed", f"vol-0000007/{a}-{b}.flushed"]
    bad = [f"/srv/vol-0000007/{a}-xxx.flushed", f"/srv/vol-0000007/{a}.flushed", f"/srv/vol-0000007/{a}_{b}.flushed", f"/srv/vol-0000007/{a}-{b}.flushed.tmp", "LOCK", "", None]
    d = S.with_name(spark.createDataFrame([(k, p) for k, p in enumerate(good + bad)], "k int, path string")).orderBy("k").collect()
    assert all((r.volume, r.low, r.high, r.state) == ("vol-0000007", a, b, "flushed") for r in d[: len(good)])
    assert all(r.low is None and r.state is None and r.volume is None for r in d[len(good) :])
    assert S.with_name(spark.createDataFrame([(f"{a}-{b}.trashed",)], "path string")).first().volume is None


def test_current(spark):
    name = f"/vol-0000001/{u(1)}-{u(2)}"
    rows = [
        ("2021-01-01 00:00:00", 1, f"{name}.flushed", 10),
        ("2021-01-03 00:00:00", 2, f"{name}.trashed", None),
        ("2021-01-02 00:00:00", 3, f"{name}.reading", -1),
        ("2021-01-03 00:00:00", 4, f"{name}.reading", None),
        ("2021-01-03 00:00:00", 4, f"{name}.reading", None),
        (None, 5, f"{name}.trashed", 99),
        ("2021-01-01 00:00:00", 6, None, 1),
    ]
    d = spark.createDataFrame(rows, "listed_at string, seg_no bigint, path string, size bigint").withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))
    assert [tuple(r) for r in S.current(d).collect()] == [("vol-0000001", u(1), u(2), "reading", 10)]
    assert S.live(d).count() == 1 and S.live(d.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_overlap_runs_and_pick(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{k:03d}", a, b) for k, (a, b) in enumerate(ranges(rng, 70, 400))] + [("long", 0, 390)] * (seed == 2)
    d = spark.createDataFrame([(k, u(b), u(a), "clash") for k, a, b in rows] + [("none", None, u(1), ""), (None, u(1), u(2), "")], "k string, low string, high string, position string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] <= b[2] and b[1] <= a[2]}
    got = S.overlap_runs(d, "k").collect()
    assert len(got) == len(rows)
    pairs = {(a.k, b.k) for a in got for b in got if a.position < b.position <= a.last_position}
    assert pairs | {(b, a) for a, b in pairs} == want and len(pairs) * 2 == len(want)
    count = {k: sum(a == k for a, _ in want) for k, _, _ in rows}
    assert {r.k: r.n_overlaps for r in got} == count
    top = min(count, key=lambda k: (-count[k], k))
    assert {r.k for r in S.compaction_pick(d, "k").collect()} == {top} | {b for a, b in want if a == top}
    assert S.compaction_pick(d, "k", 500).count() == 0 and S.compaction_pick(d.where("false"), "k").count() == 0


def test_stats_and_retention(spark):
    rows = [("flushed", 10, 5, 0), ("flushed", 20, 50, 0), ("trashed", 5, 5, 3), ("trashed", 5, 5, 99), ("active", None, 5, None)]
    d = spark.createDataFrame([(s, z, u(h), m) for s, z, h, m in rows], "state string, size_bytes bigint, high string, trashed_ms bigint")
    r = S.state_stats(d).first()
    assert (r.flushed_segments, r.flushed_bytes, r.active_bytes, r.reading_segments, r.trashed_segments) == (2, 30, 0, 0, 2)
    assert S.expired(d.where("state = 'flushed'"), 50).count() == 1
    assert S.purgeable(d, 50).count() == 1


def test_human_size(spark):
    d = spark.createDataFrame([(0,), (1000,), (1001,), (2_500_000,), (3_999_999_999,), (None,)], "s bigint")
    assert [r.x for r in d.select(S.human_size(F.col("s")).alias("x")).collect()] == ["0 Bytes", "1000 Bytes", "1 kB", "2 MB", "3 GB", None]

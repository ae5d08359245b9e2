import itertools
import random
import re
from datetime import UTC, datetime

import pytest

from tidelog.functions import ulid as U
from tidelog.operators import ingest, search
from tidelog.operators.search import LogQuery


def u(ms):
    return U.encode_ms(ms) + "0" * 16


def records(spark, rows, schema="ulid string, body string"):
    return spark.createDataFrame(rows, schema)


def bodies(df):
    return [r.body for r in df.collect()]


@pytest.mark.parametrize("seed", range(4))
def test_range_and_expression(spark, seed):
    """Against Python on random records and bounds; a bound includes its whole millisecond; identifiers aren't searched."""
    rng = random.Random(seed)
    rows = [(U.encode_ms(rng.randrange(30)) + f"{rng.randrange(10**6):016d}", rng.choice(["red", "green", "blue"]) + str(rng.randrange(4))) for _ in range(60)]
    d = records(spark, rows)
    for pattern in ("", "r.*[12]", "^b", "0{9}", "9$"):
        a, b = rng.randrange(30), rng.randrange(30)
        got = search.run(d, LogQuery(u(a), U.encode_ms(b) + "0" * 16, pattern, True)).collect()
        assert [(r.ulid, r.body) for r in got] == sorted((x, t) for x, t in dict(rows).items() if a <= U.decode_ms(x) <= b and re.search(pattern, t))


@pytest.mark.parametrize("seed", range(4))
def test_merge_first_source_wins(spark, seed):
    rng = random.Random(seed)
    sources = [[rng.randrange(25) for _ in range(rng.randrange(20))] for _ in range(seed + 1)]
    rows = [(u(ms), f"{k}-{ms}", k) for k, ids in enumerate(sources) for ms in ids]
    want = {}
    for x, body, _ in rows:  # sources in their order
        want.setdefault(x, body)
    got = search.first_source(records(spark, rows, "ulid string, body string, src int")).orderBy("ulid").collect()
    assert [(r.ulid, r.body) for r in got] == sorted(want.items())


def test_last_arrival(spark):
    d = records(spark, [(u(1), "a", 1), (u(1), "b", 3), (u(1), "c", 2)], "ulid string, body string, arrival int")
    assert bodies(search.last_arrival(d)) == ["b"]


def test_nulls_and_extra_columns(spark):
    d = records(spark, [(None, "x", 1), (u(1), None, 2), (u(2), "x", 3)], "ulid string, body string, _r int")
    assert [(r.body, r._r) for r in search.run(d, LogQuery(u(0), u(9), "x")).collect()] == [("x", 3)]


def test_query_is_checked_early():
    with pytest.raises(ValueError):
        LogQuery("never", u(1))
    with pytest.raises(ValueError):
        LogQuery(u(0), u(1), "(", True)
    with pytest.raises(ValueError):
        LogQuery.of_url({"from": u(0)})
    assert LogQuery.of_url({"from": u(0), "to": u(1), "regex": "false"}).is_regex
    q = LogQuery.of_words("1h", "now", "x", False, datetime(2020, 1, 1, 1, 0, 0, 5, UTC))
    assert (q.start, q.stop) == ("2020-01-01T00:00:00Z", "2020-01-01T01:00:00Z")


def test_a_query_needs_bounds(spark):
    with pytest.raises(ValueError):
        search.run(records(spark, []), LogQuery(q="x"))


def test_large_record(spark):
    big = "x" * 200_000
    assert bodies(search.run(records(spark, [(u(1), "a"), (u(2), big), (u(3), "b")]), LogQuery(u(0), u(9)))) == ["a", big, "b"]


def test_range_reaches_parquet(spark, tmp_path):
    records(spark, [(u(k), str(k)) for k in range(100)]).write.parquet(str(tmp_path / "r"))
    plan = search.run(spark.read.parquet(str(tmp_path / "r")), LogQuery(u(3), u(5)))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ulid), IsNotNull(body), GreaterThanOrEqual(ulid," in plan


def test_merged_stats(spark):
    d = spark.createDataFrame([(1, 3, 100, 0), (1, 2, 300, 1)], "nodes_queried int, segments_queried int, max_data_set_size bigint, error_count int")
    assert tuple(search.merged_stats(d).first()) == (2, 5, 300, 1)
    assert tuple(search.merged_stats(d.where("false")).first()) == (0, 0, 0, 0)


def test_render_and_windows(spark):
    d = records(spark, [(u(1624183818237), "t p")])
    assert [search.render(d, f).first().line for f in ("raw", "strip", "time")] == [u(1624183818237) + " t p", "t p", "2021-06-20T10:10:18Z t p"]
    assert search.window_seconds("15m") == 900 and search.window_seconds("?") == 3600


def test_topics(spark):
    """Every text of up to three of these characters, against the grammar by hand."""
    letters = ["a", "Z", "7", "-", "_", " ", "~", "é", "\n"]
    lines = ["".join(x) for n in range(4) for x in itertools.product(letters, repeat=n)]
    good, bad = ingest.dynamic_topics(spark.createDataFrame([(x,) for x in [*lines, None]], "value string"))

    def fine(line):
        topic, space, _ = line.partition(" ")
        return space and topic and topic[0] in "aZ7" and all(c in "aZ7-_" for c in topic)

    assert sorted((r.topic, r.payload) for r in good.collect()) == sorted((x.partition(" ")[0], x.partition(" ")[2]) for x in lines if fine(x))
    assert sorted(r.value or "" for r in bad.collect()) == sorted(["", *(x for x in lines if not fine(x))])


def test_static_topic(spark):
    d = ingest.static_topic(spark.createDataFrame([("foo1",), ("",), ("foo2",)], "value string"), "topic_A")
    assert [r.payload for r in d.collect()] == ["foo1", "", "foo2"]
    with pytest.raises(ValueError):
        ingest.static_topic(d, "to~pic")


def test_ids_are_the_same_again(spark):
    d = spark.range(1000).selectExpr("'t' as topic", "cast(id as string) as payload").repartition(3)
    a, b = ([r.ulid for r in ingest.with_ids(d, 7, 1000).collect()] for _ in range(2))
    assert a == b and len(set(a)) == 1000 and all(len(x) == 26 for x in a)
    assert {r.ulid[:10] for r in ingest.with_ids(d, 7, 1000).collect()} == {U.encode_ms(1000)}


def test_roll(spark):
    d = spark.createDataFrame([("a", k, s) for k, s in enumerate([40, 40, 40, 100, 5, None, 95, 1])] + [("b", 0, 1)], "g string, k int, size int")
    got = sorted((r.g, r.k, r.roll) for r in ingest.rolled(d, ["g"], "k", "size", 100).collect())
    assert [r[2] for r in got] == [0, 0, 0, 1, 2, 2, 2, 3, 0]


def test_generator(spark):
    d = ingest.generated(spark, 300, "7", 200).collect()
    assert len(d) == 300 and all(len(r.value) == 200 for r in d) and d[5].value.startswith("1970-01-01T00:00:01Z 7 000000005 ")
    words = [w for r in d for w in r.value.split(" ")[3:-1]]  # the last may be cut
    assert {len(w) for w in words} == set(range(ingest.WORDS[0], ingest.WORDS[1] + 1)) and all(w.isalpha() for w in words)
    assert len(set(words)) > 0.99 * len(words)


def test_accounting_and_functions(spark):
    d, o = search.accounted(records(spark, [(u(2), "bb"), (u(1), "a"), (u(3), "é")]))
    assert d.count() == 3 and o.get == {"low": u(1), "high": u(3), "n_records": 3, "n_bytes": 3 * 28 + 5}
    U.register(spark)
    r = spark.sql("select ulid_ms('01F8MECHZX0000000000000000') as ms, cast(ulid_ts('01F8MECHZX0000000000000000') as string) as ts").first()
    assert (r.ms, r.ts) == (1624183818237, "2021-06-20 10:10:18.237")


def test_changed_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "k string") for t in ("abc", "bcd"))
    came, went = search.changed_sets(a, b, "k")
    assert [r.k for r in came.collect()] == ["d"] and [r.k for r in went.collect()] == ["a"]

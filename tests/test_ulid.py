from datetime import UTC, datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tidelog.functions import ulid as U


@given(st.integers(0, 253_402_300_799_999), st.text("0123456789ABCDEFGHJKMNPQRSTVWXYZ", min_size=16, max_size=16))
def test_bounds_as_ulids(ms, entropy):
    ulid = U.encode_ms(ms) + entropy
    assert U.parse_bound(ulid) == (ulid, datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms))


@given(st.datetimes(datetime(1970, 1, 2), datetime(9999, 12, 30)), st.integers(0, 999), st.integers(-14, 14))
def test_bounds_as_times(t, nanos, hours):
    """Nine digits and any zone: the ULID is that of the millisecond, cut, without entropy."""
    text = f"{t:%Y-%m-%dT%H:%M:%S.%f}".rjust(26, "0") + f"{nanos:03d}{hours:+03d}:00"
    at = t.replace(tzinfo=timezone(timedelta(hours=hours))).astimezone(UTC)
    ulid, got = U.parse_bound(text)
    assert got == at and ulid == U.encode_ms((at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)) + "0" * 16


@pytest.mark.parametrize("text", ["", "yesterday", "01F8MECHZX", "8" + "1" * 25, "0" * 25 + "U", "2021-06-17"])
def test_no_bounds(text):
    with pytest.raises(ValueError):
        U.parse_bound(text)


@given(st.integers(0, U.MAX_MS))
def test_round_trip(ms):
    assert U.decode_ms(U.encode_ms(ms)) == ms


def test_order_is_time():
    ms = [0, 1, 31, 32, 10**12, U.MAX_MS]
    assert sorted(map(U.encode_ms, ms)) == [U.encode_ms(x) for x in ms]


def test_words():
    now = datetime(2020, 5, 6, 7, 8, 9, 500000, UTC)
    assert U.parse_when("NOW", now) == now.replace(microsecond=0)
    assert U.parse_when("-1h30m", now, False) == U.parse_when("1h30m", now, False) == now - timedelta(minutes=90)
    assert U.parse_when("2020-01-01T00:00:00.9+01:00", now) == datetime(2019, 12, 31, 23, 0, 0, 0, UTC)
    assert U.parse_duration("250ms") == timedelta(milliseconds=250)
    with pytest.raises(ValueError):
        U.parse_duration("5 parsecs")


def test_columns(spark):
    rows = [(0, 0), (1624000000000, 7), (U.MAX_MS, 2**40)]
    got = spark.createDataFrame(rows, "ms bigint, e bigint").select("ms", U.ulid_of(F.col("ms"), F.col("e")).alias("u")).withColumn("back", U.ulid_ms(F.col("u"))).collect()
    assert [r.back for r in got] == [r.ms for r in got]
    assert got[1].u == U.encode_ms(1624000000000) + "0" * 15 + "7" and all(len(r.u) == 26 for r in got)


def test_normal(spark):
    u = "01F8MECHZX0000000000000000"
    rows = [(u,), (u.lower(),), (f" {u}\t",), (f"﻿{u}",), (None,), ("",), (u[:-1],), ("8" + u[1:],), (u[:-1] + "U",), (u[:-1] + "ſ",)]
    got = [r.x for r in spark.createDataFrame(rows, "s string").select(U.normal_ulid(F.col("s")).alias("x")).collect()]
    assert got == [u] * 4 + [None] * 6

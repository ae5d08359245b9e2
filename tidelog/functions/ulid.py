"""Column expressions and driver-side helpers for ULIDs.

A ULID is 26 characters of Crockford base 32: ten for the UTC millisecond, sixteen for entropy.
Byte order of the upper-case text is numeric order, so ranges stay sargable in Parquet.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two base-32 alphabets, and what surrounds an identifier without counting.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ULID_PATTERN = "^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
ANY_CASE_PATTERN = "^[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}\\z"
AROUND = "[\\s\\x{FEFF}\\x{00A0}\\x{200B}]"

_STRICT = re.compile(ULID_PATTERN)
MAX_MS = (1 << 48) - 1


def trimmed(c: Column) -> Column:
    """Text without white space and byte-order marks at either end; null stays null."""
    return F.regexp_replace(c, f"^{AROUND}+|{AROUND}+\\z", "")


def normal_ulid(c: Column) -> Column:
    """The identifier in upper case, or null where the text is no ULID (also for null)."""
    t = trimmed(c)
    return F.coalesce(F.when(c.rlike(ANY_CASE_PATTERN), F.upper(c)), F.when(t.rlike(ANY_CASE_PATTERN), F.upper(t)))


def ulid_ms(c: Column) -> Column:
    """UTC milliseconds of a valid upper-case ULID."""
    return F.conv(F.translate(F.substring(c, 1, 10), CROCKFORD, BASE32), 32, 10).cast("bigint")


def ulid_ts(c: Column) -> Column:
    return F.timestamp_millis(ulid_ms(c))


def encode(value: Column, width: int) -> Column:
    """A non-negative bigint in Crockford base 32, left-padded with zeros."""
    return F.lpad(F.translate(F.conv(value.cast("string"), 10, 32), BASE32, CROCKFORD), width, "0")


def ulid_of(ms: Column, entropy: Column | None = None) -> Column:
    """A ULID from milliseconds and a non-negative bigint of entropy (zero if none)."""
    return F.concat(encode(ms, 10), F.lit("0" * 16) if entropy is None else encode(entropy, 16))


def ms_of_ts(ts: Column) -> Column:
    """Milliseconds of a timestamp, cut and not rounded (session zone must be UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def encode_ms(ms: int) -> str:
    if not 0 <= ms <= MAX_MS:
        raise ValueError(f"no ULID has the time {ms}")
    return "".join(CROCKFORD[(ms >> (5 * k)) & 31] for k in range(9, -1, -1))


def decode_ms(ulid: str) -> int:
    ms = 0
    for ch in ulid[:10]:
        ms = ms * 32 + CROCKFORD.index(ch)
    return ms


def parse_time(text: str) -> datetime:
    """RFC 3339 with up to nine fractional digits; digits past the microsecond are cut."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)", text)
    if not m:
        raise ValueError(f"neither ULID nor RFC 3339 time: {text!r}")
    zone = "+00:00" if m[4] in "Zz" else m[4]
    return datetime.fromisoformat(f"{m[1]}T{m[2]}.{(m[3] or '0')[:6].ljust(6, '0')}{zone}").astimezone(UTC)


def ms_of(t: datetime) -> int:
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def parse_bound(text: str) -> tuple[str, datetime]:
    """A query bound, ULID first and then RFC 3339: the ULID and its time. ValueError if neither."""
    if _STRICT.match(text):
        # identifiers go on to the year 10889, times of this type to 9999
        return text, datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=min(decode_ms(text), 253_402_300_799_999))
    t = parse_time(text)
    return encode_ms(ms_of(t)) + "0" * 16, t


# The units of durations, in nanoseconds.
_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def parse_duration(text: str) -> timedelta:
    """A duration such as 1h30m or -250ms."""
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h))+|0)", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    ns = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h)", m[2]))
    return timedelta(microseconds=ns / 1000) * (-1 if m[1] == "-" else 1)


def parse_when(text: str, now: datetime, to_seconds: bool = True) -> datetime:
    """'now' in any case, a duration ago (its sign is ignored) or an RFC 3339 time; cut to seconds as the command line does."""
    if text.lower() == "now":
        t = now
    else:
        try:
            t = now - abs(parse_duration(text))
        except ValueError:
            t = parse_time(text)
    return t.replace(microsecond=0) if to_seconds else t


def low_of(text: str) -> str:
    """Smallest ULID in the millisecond of a bound."""
    return parse_bound(text)[0][:10] + "0" * 16


def high_of(text: str) -> str:
    """Largest ULID in the millisecond of a bound (bounds include their whole millisecond)."""
    return parse_bound(text)[0][:10] + "Z" * 16


def stream_clock_entropy(batch: int, partition: Column, position: Column) -> Column:
    """Sixteen characters of entropy that a retried micro-batch gives again: batch, partition, position."""
    return F.concat(encode(F.lit(batch), 6), encode(partition, 4), encode(position, 6))


def register(spark) -> None:
    """SQL functions ulid_ms(text) and ulid_ts(text) for the session: SQL themselves, so that they are optimised like any expression."""
    ms = f"cast(conv(translate(substring(u, 1, 10), '{CROCKFORD}', '{BASE32}'), 32, 10) as bigint)"
    spark.sql(f"create or replace temporary function ulid_ms(u string) returns bigint return {ms}")
    spark.sql(f"create or replace temporary function ulid_ts(u string) returns timestamp return timestamp_millis({ms})")

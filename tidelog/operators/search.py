"""Search over records: an inclusive time range, a text or expression, and a result in order without duplicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.functions import regex
from tidelog.functions import ulid as U
from tidelog.operators import segments


@dataclass(frozen=True)
class LogQuery:
    """What a query asks for. Bounds are ULIDs or RFC 3339 times and include their millisecond; an empty q matches everything."""

    start: str | None = None
    stop: str | None = None
    q: str = ""
    is_regex: bool = False

    def __post_init__(self) -> None:
        for bound in (self.start, self.stop):
            if bound is not None:
                U.parse_bound(bound)
        if self.is_regex:
            regex.translate(self.q)

    @staticmethod
    def of_words(start: str, stop: str, q: str, is_regex: bool, now: datetime) -> LogQuery:
        """From a command line: 'now', a duration ago, or a time, cut to seconds."""
        text = lambda t: U.parse_when(t, now).strftime("%Y-%m-%dT%H:%M:%SZ")
        return LogQuery(text(start), text(stop), q, is_regex)

    @staticmethod
    def of_url(params: dict[str, str]) -> LogQuery:
        """From URL parameters: from and to are required, and `regex` counts by being there."""
        if "from" not in params or "to" not in params:
            raise ValueError("from and to are required")
        return LogQuery(params["from"], params["to"], params.get("q", ""), "regex" in params)


def matches(query: LogQuery, body: Column) -> Column:
    """Whether a body (topic and payload, without line end and without identifier) matches. Case counts."""
    return body.rlike(regex.translate(query.q)) if query.is_regex else F.contains(body, F.lit(query.q))


def in_range(query: LogQuery, ulid: Column) -> Column:
    """The range as a comparison of whole ULIDs, which Parquet statistics can answer."""
    cond = F.lit(True)
    if query.start is not None:
        cond = cond & (ulid >= U.low_of(query.start))
    if query.stop is not None:
        cond = cond & (ulid <= U.high_of(query.stop))
    return cond


def first_source(records: DataFrame, key: str = "ulid", source: str = "src") -> DataFrame:
    """One record per identifier, that of the lowest source; combined on the map side."""
    rest = [c for c in records.columns if c not in (key, source)]
    return records.groupBy(key).agg(F.min_by(F.struct(source, *rest), source).alias("_r")).select(key, "_r.*")


def last_arrival(records: DataFrame, key: str = "ulid", arrival: str = "arrival") -> DataFrame:
    """One record per identifier, the one that came last."""
    rest = [c for c in records.columns if c not in (key, arrival)]
    return records.groupBy(key).agg(F.max_by(F.struct(arrival, *rest), arrival).alias("_r")).select(key, "_r.*")


def run(records: DataFrame, query: LogQuery, ordered: bool = True, extra: Column | None = None) -> DataFrame:
    """Records (ulid, body, ... and perhaps src) that match, without duplicates, in order of identifier.

    A query without both bounds is refused, as a search over all time is a tail. Of copies the lowest src counts. Rows with a null
    ulid or body match nothing; an empty table gives no rows. With start above stop there are none either.
    """
    if query.start is None or query.stop is None:
        raise ValueError("a query needs both bounds")
    d = records.where(in_range(query, F.col("ulid")) & matches(query, F.col("body")))
    if extra is not None:
        d = d.where(extra)
    d = first_source(d) if "src" in d.columns else d.dropDuplicates(["ulid"])
    return d.orderBy("ulid") if ordered else d


def page(records: DataFrame, query: LogQuery, n: int, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """n records of a search from the offset-th on, in order of identifier, the newest first (or last): an extension. Each task sends n + offset at most."""
    d = run(records, query, ordered=False)
    return d.orderBy(F.col("ulid").desc() if newest_first else F.col("ulid")).offset(offset).limit(n)


def stats(index: DataFrame, query: LogQuery) -> DataFrame:
    """The statistics-only query; bounds given high end first still count segments."""
    return segments.scan_stats(index, U.low_of(query.start), U.high_of(query.stop))


def merged_stats(per_node: DataFrame) -> DataFrame:
    """Statistics of several nodes' results in one: sums, but the largest data set size."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per_node.agg(total("nodes_queried"), total("segments_queried"), F.coalesce(F.max("max_data_set_size"), F.lit(0)).alias("max_data_set_size"), total("error_count"))


def under_replicated(copies: DataFrame, factor: int) -> DataFrame:
    """Identifiers with copies on fewer than `factor` sources, for read repair."""
    return copies.groupBy("ulid").agg(F.countDistinct("src").alias("n_sources")).where(F.col("n_sources") < factor)


def render(records: DataFrame, form: str = "strip") -> DataFrame:
    """One column `line`: 'raw' (with identifier), 'strip' (without) or 'time' (with its time, to the second, in the session's zone)."""
    if form == "raw":
        return records.select(F.concat_ws(" ", "ulid", "body").alias("line"))
    if form == "strip":
        return records.select(F.col("body").alias("line"))
    if form == "time":
        return records.select(F.concat_ws(" ", F.date_format(U.ulid_ts(F.col("ulid")), "yyyy-MM-dd'T'HH:mm:ssXXX"), "body").alias("line"))
    raise ValueError(form)


def highlighted(body: Column, q: str, left: str = "«", right: str = "»") -> Column:
    """The text with each occurrence of a plain q marked."""
    return body if not q else F.replace(body, F.lit(q), F.lit(left + q + right))


# The windows on offer; an unknown one is an hour.
WINDOWS = {"5m": 300, "15m": 900, "1h": 3600, "12h": 43_200, "1d": 86_400, "3d": 259_200, "7d": 604_800}


def window_seconds(name: str) -> int:
    return WINDOWS.get(name, WINDOWS["1h"])


def accounted(records: DataFrame, name: str = "account"):
    """records, and an Observation of them: when they have been written it holds low, high, n_records and n_bytes, without a second pass."""
    o = Observation(name)
    size = F.octet_length("ulid") + F.octet_length("body") + 2
    return records.observe(o, F.min("ulid").alias("low"), F.max("ulid").alias("high"), F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")), o


def changed_sets(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Members of new that old lacks, and of old that new lacks."""
    return new.join(old, key, "left_anti"), old.join(new, key, "left_anti")

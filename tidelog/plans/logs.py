"""Queries of the store on events and documents: search, rendering, replicas, the segment index, upkeep and live queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ulid as U
from tidelog.functions.scale import shared_dir
from tidelog.operators import ingest, search, segments
from tidelog.operators.search import LogQuery
from tidelog.sources.tables import document_lines, event_records, event_ulid, table
from tidelog.streaming import tail

FROM, TO = "2024-01-05T00:00:00Z", "2024-01-20T12:00:00.500Z"
RANGE = LogQuery(FROM, TO)
PACK_BYTES, ROLL_BYTES = 5_000, 15_000
OLDEST_MS = 1_704_844_800_000  # 2024-01-10


# --- search ---------------------------------------------------------------------------------------------------------


def grep_plain_bounded(spark: SparkSession, folder: str) -> DataFrame:
    return search.run(event_records(spark, folder, FROM, TO), LogQuery(FROM, TO, '"k": 4')).select("ulid", "body")


def grep_range_sargable(spark: SparkSession, folder: str) -> DataFrame:
    return search.run(event_records(spark, folder, FROM, TO), RANGE, ordered=False).select("ulid")


def grep_regex(spark: SparkSession, folder: str) -> DataFrame:
    return search.run(event_records(spark, folder, FROM, TO), LogQuery(FROM, TO, '^(error|view) .*[[:digit:]]{2}\\}$', True)).select("ulid", "body")


def grep_regex_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    q = LogQuery(q="(?P<kind>sign|purch)\\w+ .*: 1[0-9]*", is_regex=True)
    return event_records(spark, folder).where(search.matches(q, F.col("body"))).select("ulid", "body")


def grep_topic(spark: SparkSession, folder: str) -> DataFrame:
    q = LogQuery(q="^error ", is_regex=True)
    return event_records(spark, folder).where(search.matches(q, F.col("body"))).select("ulid", "body")


def grep_id_not_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers aren't searched: records whose body holds their own time prefix."""
    return event_records(spark, folder).where(F.contains("body", F.substring("ulid", 1, 10))).agg(F.count(F.lit(1)).alias("n"))


def grep_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of twenty, newest first: extension."""
    return search.page(event_records(spark, folder, FROM, TO), LogQuery(FROM, TO, "error"), 20, 20).select("ulid", "body")


def render_raw(spark: SparkSession, folder: str) -> DataFrame:
    return search.render(event_records(spark, folder), "raw")


def render_strip(spark: SparkSession, folder: str) -> DataFrame:
    return search.render(event_records(spark, folder), "strip")


def render_time(spark: SparkSession, folder: str) -> DataFrame:
    return search.render(event_records(spark, folder), "time")


def ulid_encode(spark: SparkSession, folder: str) -> DataFrame:
    return event_records(spark, folder).select("event_id", "ulid")


def ulid_decode(spark: SparkSession, folder: str) -> DataFrame:
    return event_records(spark, folder).select("event_id", U.ulid_ms(F.col("ulid")).alias("ts_ms"))


def highlight(spark: SparkSession, folder: str) -> DataFrame:
    q = LogQuery(q="click")
    d = event_records(spark, folder).where(search.matches(q, F.col("body")))
    return d.select("ulid", search.highlighted(F.col("body"), "click").alias("line"))


def json_post_filter(spark: SparkSession, folder: str) -> DataFrame:
    return event_records(spark, folder).where(F.get_json_object("payload", "$.k") == "50").select("ulid", F.get_json_object("payload", "$.k").alias("k"))


def documents_grep(spark: SparkSession, folder: str) -> DataFrame:
    q = LogQuery(q="council")
    return document_lines(spark, folder, q.q).where(search.matches(q, F.col("line"))).select("doc_id", "line_no", "line")


def documents_regex_b(spark: SparkSession, folder: str) -> DataFrame:
    """ASCII word edges, also beside letters with accents."""
    q = LogQuery(q=r"\b(la|des?|mes)\b", is_regex=True)
    return document_lines(spark, folder).where(search.matches(q, F.col("line"))).select("doc_id", "line_no")


def documents_regex_i(spark: SparkSession, folder: str) -> DataFrame:
    """Case-insensitive for all letters."""
    q = LogQuery(q="(?i)PRÄSIDENT|présidente", is_regex=True)
    return document_lines(spark, folder).where(search.matches(q, F.col("line"))).select("doc_id", "line_no")


def documents_regex_posix(spark: SparkSession, folder: str) -> DataFrame:
    q = LogQuery(q="[[:upper:]]{4,}[^[:alnum:]]*[[:digit:]]?$", is_regex=True)
    return document_lines(spark, folder).where(search.matches(q, F.col("line"))).select("doc_id", "line_no")


def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records by line feed alone; a carriage return stays."""
    return document_lines(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars_kept"))


# --- replicas -------------------------------------------------------------------------------------------------------


def copies(spark: SparkSession, folder: str) -> DataFrame:
    """Two replicas, each with records missing, the second with other bodies."""
    r = event_records(spark, folder).select("ulid", "body", "event_id")
    first = r.where("event_id % 7 != 3").select("ulid", "body", F.lit(0).alias("src"))
    second = r.where("event_id % 5 != 2").select("ulid", F.concat("body", F.lit(" #1")).alias("body"), F.lit(1).alias("src"))
    return first.unionByName(second)


def replica_merge(spark: SparkSession, folder: str) -> DataFrame:
    return search.first_source(copies(spark, folder)).select("ulid", "body", "src")


def replica_merge_bounded(spark: SparkSession, folder: str) -> DataFrame:
    return search.run(copies(spark, folder), LogQuery(FROM, TO, "error")).select("ulid", "body")


def replica_under_replicated(spark: SparkSession, folder: str) -> DataFrame:
    return search.under_replicated(copies(spark, folder), 2).select("ulid", F.col("n_sources").cast("bigint").alias("n_sources"))


def replica_stats_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of one query on each replica, merged: sums, and the largest data set."""
    c = copies(spark, folder)
    hit = search.in_range(RANGE, F.col("ulid"))
    node = c.where(hit).groupBy("src").agg(F.count_distinct(F.substring("ulid", 1, 5)).alias("segments_queried"), F.sum(F.octet_length("body")).alias("max_data_set_size"))
    return search.merged_stats(node.select(F.lit(1).alias("nodes_queried"), "segments_queried", "max_data_set_size", F.lit(0).alias("error_count")))


def merge_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Low and high identifier, records and bytes of a merge."""
    d = search.first_source(copies(spark, folder))
    return d.agg(F.min("ulid").alias("low"), F.max("ulid").alias("high"), F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("ulid") + F.octet_length("body") + 2).alias("n_bytes"))


def tail_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The tail's rule in batch form: of copies, the one that came last."""
    return search.last_arrival(copies(spark, folder).withColumnRenamed("src", "arrival")).select("ulid", "body")


# --- segments -------------------------------------------------------------------------------------------------------


def lane_index(spark: SparkSession, folder: str) -> DataFrame:
    """A segment index: four writers with files of 6 to 15 hours each, so that files of different writers overlap."""
    r = event_records(spark, folder).withColumn("lane", F.col("event_id") % 4)
    r = r.withColumn("bucket", F.expr("cast(floor(unix_millis(ts) / (3600000 * (6 + 3 * lane))) as bigint)"))
    i = segments.index_of(r, ["lane", "bucket"])
    return i.withColumn("segment", F.concat_ws("/", F.col("lane").cast("string"), F.col("bucket").cast("string")))


def segment_index(spark: SparkSession, folder: str) -> DataFrame:
    return lane_index(spark, folder).select("segment", "low", "high", "n_records", "size_bytes")


def segment_prune(spark: SparkSession, folder: str) -> DataFrame:
    return segments.pruned(lane_index(spark, folder), U.low_of(FROM), U.high_of(TO)).select("segment")


def segment_prune_stats(spark: SparkSession, folder: str) -> DataFrame:
    return search.stats(lane_index(spark, folder), RANGE)


def segment_range_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The overlap test with bounds given either way round."""
    i = lane_index(spark, folder)
    return i.select("segment", segments.overlap(F.col("high"), F.col("low"), F.lit(U.high_of(TO)), F.lit(U.low_of(FROM))).alias("hit"))


def segment_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of segment files taken apart."""
    d = segments.with_name(table(spark, folder, "read_segments").select("seg_no", "path"))
    return d.select("seg_no", "volume", "low", "high", "state")


def segment_bad_names(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are no segments: they are listed, never deleted by a read."""
    return segments.with_name(table(spark, folder, "read_segments").select("seg_no", "path")).where("low is null").select("seg_no", "path")


def segment_overlap_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of segments that overlap, as a run of followers for each."""
    return segments.overlap_runs(lane_index(spark, folder), "segment")


def segment_overlap_pick(spark: SparkSession, folder: str) -> DataFrame:
    return segments.compaction_pick(lane_index(spark, folder), "segment")


def segment_islands(spark: SparkSession, folder: str) -> DataFrame:
    return segments.islands(lane_index(spark, folder), ["lane"]).select("segment", "island")


def segment_bin_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that are put together first, in order."""
    return segments.first_sequential(lane_index(spark, folder), "segment", "size_bytes", PACK_BYTES).select("position", "segment")


def segment_roll(spark: SparkSession, folder: str) -> DataFrame:
    """Files that each lane's segments are rolled into."""
    return ingest.rolled(lane_index(spark, folder).select("lane", "segment", "low", "size_bytes"), ["lane"], "low", "size_bytes", ROLL_BYTES).select("segment", "roll")


def segment_state(spark: SparkSession, folder: str) -> DataFrame:
    """The lanes' segments with a state and the time of the last move."""
    state = F.element_at(F.array(*[F.lit(s) for s in segments.STATES]), (F.pmod("bucket", F.lit(4)) + 1).cast("int"))
    return lane_index(spark, folder).withColumn("state", state).withColumn("trashed_ms", U.ulid_ms(F.col("high")) + 86_400_000)


def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return segments.state_stats(segment_state(spark, folder))


def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = segment_state(spark, folder).withColumn("state", F.when(F.col("state") == "reading", "pending").otherwise(F.col("state")))
    return segments.state_stats(d, ("active", "flushed", "pending"))


def retention_trash(spark: SparkSession, folder: str) -> DataFrame:
    return segments.expired(lane_index(spark, folder), OLDEST_MS).select("segment")


def retention_purge(spark: SparkSession, folder: str) -> DataFrame:
    return segments.purgeable(segment_state(spark, folder), OLDEST_MS).select("segment")


def oldest_flushed(spark: SparkSession, folder: str) -> DataFrame:
    """The flushed segment that was written first."""
    d = segment_state(spark, folder).where("state = 'flushed'")
    return d.agg(F.min_by("segment", F.struct("trashed_ms", "segment")).alias("segment"), F.min("trashed_ms").alias("modified_ms"))


def human_size(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "read_segments").where("size >= 0").select("seg_no", segments.human_size(F.col("size")).alias("text"))


def recovered_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index made again from records: low and high of each batch."""
    r = table(spark, folder, "merge_records").select("batch_id", U.normal_ulid(F.substring_index("record", " ", 1)).alias("ulid")).where("ulid is not null")
    return r.groupBy("batch_id").agg(F.min("ulid").alias("low"), F.max("ulid").alias("high"), F.count(F.lit(1)).alias("n_records"))


def batch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Transfers by outcome and peer type; one without an outcome is pending."""
    b, p = table(spark, folder, "batches"), table(spark, folder, "peers")
    d = b.join(p, "peer_id").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
    held = F.unix_millis(F.col("closed_at").cast("timestamp")) - F.unix_millis(F.col("opened_at").cast("timestamp"))
    return d.groupBy("peer_type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max(held).alias("longest_ms"))


# --- topics, live queries, the logs view ----------------------------------------------------------------------------


def topic_validate(spark: SparkSession, folder: str) -> DataFrame:
    lines = event_records(spark, folder).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("~"), "body")).when(F.col("event_id") % 3 == 1, F.translate("body", " ", "")).otherwise(F.col("body")).alias("value"))
    return ingest.split_topic(lines).select("event_id", "topic", "topic_ok")


def topic_static(spark: SparkSession, folder: str) -> DataFrame:
    d = ingest.static_topic(event_records(spark, folder).select("event_id", F.col("payload").alias("value")), "events-a")
    return d.select("event_id", F.concat_ws(" ", "topic", "payload").alias("body"))


def forward_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.prefixed(event_records(spark, folder).select("event_id", F.col("payload").alias("value")), ["web", "eu"]).select("event_id", "value")


def live_query_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Each record to each registered query that it matches."""
    live = tail.Registry()
    for name, q in {"errors": "error", "ones": '"k": 1', "most": "e"}.items():
        live.register(name, LogQuery(q=q))
    return live.match(event_records(spark, folder)).select("query", "ulid")


def logs_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """SQL over the view of records: extension."""
    event_records(spark, folder).createOrReplaceTempView("logs")
    return spark.sql("select topic, (unix_millis(ts) div 3600000) as hour, count(*) as n, count(distinct get_json_object(payload, '$.k')) as n_k from logs group by 1, 2")


def logs_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user by a gap of six hours: extension."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    d = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")


# --- streams, run to their end --------------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, only: str = "true") -> DataFrame:
    """The copies as a stream: events are read as they would come. only: a condition on events."""
    e = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]").where(only)  # a pattern may be a file or a folder
    r = e.select(event_ulid(F.col("ts"), F.col("event_id")).alias("ulid"), F.concat_ws(" ", "event_type", "props").alias("body"))
    return r.select("ulid", F.explode(F.array(*[F.struct(F.when(F.lit(k == 0), F.col("body")).otherwise(F.concat("body", F.lit(f" #{k}"))).alias("body"), F.lit(k).cast("bigint").alias("arrival")) for k in range(2)])).alias("c")).select("ulid", "c.*")


def _to_the_end(stream: DataFrame, what: str) -> DataFrame:
    """What a stream gives out when it has taken all that is there, as a table in the shared folder."""
    out = shared_dir(stream.sparkSession, what)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_grep(spark: SparkSession, folder: str) -> DataFrame:
    """A live query without repeats over both copies of each record: Spark's own operator, which keeps any one of them."""
    d = _stream(spark, folder).where(search.matches(LogQuery(q="error"), F.col("body"))).withColumn("body", F.regexp_replace("body", " #1$", ""))
    return _to_the_end(tail.distinct_stream(d.select("ulid", "body"), "40 days"), "stream-grep")


def stream_tail(spark: SparkSession, folder: str) -> DataFrame:
    """A tail by event time: of the two copies the last counts, once the window of an hour has passed it. Events without a type or props have no body."""
    out = shared_dir(spark, "stream-tail")
    stream = tail.tail(_stream(spark, folder, "event_type is not null and props is not null"), LogQuery(q="error"), "1h", event_time=True)
    q = tail.in_order(stream, lambda d, n: d.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{out}-check", availableNow=True)
    q.awaitTermination()
    return spark.read.schema("ulid string, body string").parquet(out).select("ulid", "body")


def stream_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Records by hour and topic of a live stream, each hour when the watermark has passed it: extension."""
    d = _stream(spark, folder).withColumn("at", U.ulid_ts(F.col("ulid"))).withWatermark("at", "1 hour")
    d = d.groupBy(F.window("at", "1 hour").alias("w"), F.substring_index("body", " ", 1).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return _to_the_end(d.select((F.unix_millis("w.start") / 3_600_000).cast("bigint").alias("hour"), "topic", "n"), "stream-hour")


NAMES = [
    "grep_plain_bounded", "grep_range_sargable", "grep_regex", "grep_regex_unbounded", "grep_topic", "grep_id_not_matched", "grep_newest", "render_raw", "render_strip", "render_time",
    "ulid_encode", "ulid_decode", "highlight", "json_post_filter", "documents_grep", "documents_regex_b", "documents_regex_i", "documents_regex_posix", "split_lines",
    "replica_merge", "replica_merge_bounded", "replica_under_replicated", "replica_stats_merge", "merge_accounting", "tail_last_wins",
    "segment_index", "segment_prune", "segment_prune_stats", "segment_range_overlap", "segment_names", "segment_bad_names", "segment_overlap_runs",
    "segment_overlap_pick", "segment_islands", "segment_bin_pack", "segment_roll", "store_stats", "ingest_stats", "retention_trash", "retention_purge", "oldest_flushed",
    "human_size", "recovered_index", "batch_outcomes", "topic_validate", "topic_static", "forward_prefix", "live_query_fanout", "logs_by_hour", "logs_sessions",
    "stream_grep", "stream_tail", "stream_by_hour",
]
QUERIES = {name: globals()[name] for name in NAMES}

# --- the same in SQL ------------------------------------------------------------------------------------------------

_A, _B = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
REC = f"""rec as (select translate(to_base(epoch_us(ts)//1000, 32, 10), '{_A}', '{_B}') || translate(to_base(event_id, 32, 16), '{_A}', '{_B}') as ulid,
    event_type as topic, props as payload, event_type || ' ' || props as body, event_id, epoch_us(ts)//1000 as ms, ts from events)"""
_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents)"
_COPIES = f"""{REC}, copies as (select ulid, body, 0 as src from rec where event_id % 7 != 3 union all select ulid, body || ' #1', 1 from rec where event_id % 5 != 2),
    merged as (select ulid, arg_min(body, src) as body, min(src) as src from copies group by ulid)"""
_INDEX = f"""{REC}, idx as (select (event_id % 4)::varchar || '/' || (ms // (3600000 * (6 + 3 * (event_id % 4))))::varchar as segment, event_id % 4 as lane, ms // (3600000 * (6 + 3 * (event_id % 4))) as bucket,
    min(ulid) as low, max(ulid) as high, count(*) as n_records, sum(strlen(ulid) + 1 + strlen(body) + 1)::bigint as size_bytes from rec group by 1, 2, 3)"""
_LO, _HI = U.encode_ms(U.decode_ms(U.low_of(FROM))), U.encode_ms(U.decode_ms(U.low_of(TO)))
_HIT = f"low <= '{_HI}ZZZZZZZZZZZZZZZZ' and high >= '{_LO}'"
_PAIRS = f"{_INDEX}, pairs as (select a.segment, b.segment as other from idx a join idx b on a.segment != b.segment and a.low <= b.high and b.low <= a.high)"
_STATE = f"""{_INDEX}, st as (select *, ['active', 'flushed', 'reading', 'trashed'][bucket % 4 + 1] as state,
    (select ms from rec where rec.ulid = high) + 86400000 as trashed_ms from idx)"""
_ID = "[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}"
_NAMES = f"""raw as (select seg_no, path, replace(trim(path, ' ' || chr(9) || chr(10) || chr(13)), chr(92), '/') as p from read_segments),
    parts as (select seg_no, path, lower(regexp_extract(p, '(?i)(?:^|/)(vol-[0-9]{{7}})/', 1)) as v, regexp_extract(string_split(p, '/')[-1], '^({_ID})-({_ID})\\.([A-Za-z]+)$', ['a', 'b', 's']) as n from raw),
    named as (select seg_no, path, case when n.a != '' and v != '' then v end as volume, case when n.a != '' then least(upper(n.a), upper(n.b)) end as low,
    case when n.a != '' then greatest(upper(n.a), upper(n.b)) end as high, case when n.a != '' then lower(n.s) end as state from parts)"""


def _stats(states: tuple[str, ...]) -> str:
    return ", ".join(f"count(*) filter (state = '{s}') as {s}_segments, coalesce(sum(size_bytes) filter (state = '{s}'), 0)::bigint as {s}_bytes" for s in states)


SQL = {
    "grep_plain_bounded": f"with {REC} select ulid, body from rec where substr(ulid, 1, 10) between '{_LO}' and '{_HI}' and contains(body, '\"k\": 4')",
    "grep_range_sargable": f"with {REC} select ulid from rec where substr(ulid, 1, 10) between '{_LO}' and '{_HI}'",
    "grep_regex": f"with {REC} select ulid, body from rec where substr(ulid, 1, 10) between '{_LO}' and '{_HI}' and regexp_matches(body, '^(error|view) .*[[:digit:]]{{2}}\\}}$')",
    "grep_regex_unbounded": f"with {REC} select ulid, body from rec where regexp_matches(body, '(?P<kind>sign|purch)\\w+ .*: 1[0-9]*')",
    "grep_topic": f"with {REC} select ulid, body from rec where starts_with(body, 'error ')",
    "grep_id_not_matched": f"with {REC} select count(*) as n from rec where contains(body, substr(ulid, 1, 10))",
    "grep_newest": f"with {REC} select ulid, body from rec where substr(ulid, 1, 10) between '{_LO}' and '{_HI}' and contains(body, 'error') order by ulid desc limit 20 offset 20",
    "render_raw": f"with {REC} select ulid || ' ' || body as line from rec",
    "render_strip": f"with {REC} select body as line from rec",
    "render_time": f"with {REC} select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || body as line from rec",
    "ulid_encode": f"with {REC} select event_id, ulid from rec",
    "ulid_decode": f"with {REC} select event_id, ms as ts_ms from rec",
    "highlight": f"with {REC} select ulid, replace(body, 'click', '«click»') as line from rec where contains(body, 'click')",
    "json_post_filter": f"with {REC} select ulid, json_extract_string(payload, '$.k') as k from rec where json_extract_string(payload, '$.k') = '50'",
    "documents_grep": f"with {_LINES} select doc_id, line_no, line from lines where contains(line, 'council')",
    "documents_regex_b": rf"with {_LINES} select doc_id, line_no from lines where regexp_matches(line, '\b(la|des?|mes)\b')",
    "documents_regex_i": f"with {_LINES} select doc_id, line_no from lines where regexp_matches(line, '(?i)PRÄSIDENT|présidente')",
    "documents_regex_posix": f"with {_LINES} select doc_id, line_no from lines where regexp_matches(line, '[[:upper:]]{{4,}}[^[:alnum:]]*[[:digit:]]?$')",
    "split_lines": f"with {_LINES} select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars_kept from lines group by doc_id",
    "replica_merge": f"with {_COPIES} select ulid, body, src from merged",
    "replica_merge_bounded": f"with {_COPIES} select ulid, body from merged where substr(ulid, 1, 10) between '{_LO}' and '{_HI}' and contains(body, 'error')",
    "replica_under_replicated": f"with {_COPIES} select ulid, count(distinct src) as n_sources from copies group by ulid having count(distinct src) < 2",
    "replica_stats_merge": f"""with {_COPIES}, node as (select src, count(distinct substr(ulid, 1, 5)) as s, sum(strlen(body)) as b from copies where substr(ulid, 1, 10) between '{_LO}' and '{_HI}' group by src)
        select count(*) as nodes_queried, sum(s)::bigint as segments_queried, max(b)::bigint as max_data_set_size, 0::bigint as error_count from node""",
    "merge_accounting": f"with {_COPIES} select min(ulid) as low, max(ulid) as high, count(*) as n_records, sum(strlen(ulid) + strlen(body) + 2)::bigint as n_bytes from merged",
    "tail_last_wins": f"with {_COPIES} select ulid, arg_max(body, src) as body from copies group by ulid",
    "segment_index": f"with {_INDEX} select segment, low, high, n_records, size_bytes from idx",
    "segment_prune": f"with {_INDEX} select segment from idx where {_HIT}",
    "segment_prune_stats": f"with {_INDEX} select count(*) as segments_queried, coalesce(sum(size_bytes), 0)::bigint as max_data_set_size from idx where {_HIT}",
    "segment_range_overlap": f"with {_INDEX} select segment, {_HIT} as hit from idx",
    "segment_names": f"with {_NAMES} select seg_no, volume, low, high, state from named",
    "segment_bad_names": f"with {_NAMES} select seg_no, path from named where low is null",
    "segment_overlap_runs": f"""with {_PAIRS}, n as (select segment, count(*) as n from pairs group by 1), p as (select segment, low, high, row_number() over (order by low, segment) as position from idx)
        select p.segment, position, (select max(o.position) from p o where o.low <= p.high) as last_position, coalesce(n, 0) as n_overlaps from p left join n using (segment)""",
    "segment_overlap_pick": f"""with {_PAIRS}, top as (select segment from (select segment, count(*) as n from pairs group by 1) where n >= 2 order by n desc, segment limit 1)
        select segment from top union all select other from pairs join top using (segment)""",
    "segment_islands": f"""with {_INDEX}, i as (select *, max(high) over (partition by lane order by low, high rows between unbounded preceding and 1 preceding) as before from idx)
        select segment, (sum(case when before is null or low > before then 1 else 0 end) over (partition by lane order by low, high rows unbounded preceding))::bigint as island from i""",
    "segment_bin_pack": f"""with recursive {_INDEX}, o as (select segment, size_bytes as s, row_number() over (order by low, segment) as n from idx),
        fold(n, first, total, done) as (select 0::bigint, 1::bigint, 0::bigint, false union all
            select o.n, case when total + s <= {PACK_BYTES} or o.n - first >= 2 then first when s <= {PACK_BYTES} then o.n else o.n + 1 end,
                case when total + s <= {PACK_BYTES} then total + s when o.n - first >= 2 then total when s <= {PACK_BYTES} then s else 0 end, total + s > {PACK_BYTES} and o.n - first >= 2
            from fold join o on o.n = fold.n + 1 where not done),
        fin as (select first, case when done then n - 1 else n end as final from fold order by n desc limit 1)
        select (o.n - first)::integer as position, segment from o join fin on o.n between first and final where final - first >= 1""",
    "segment_roll": f"""with recursive {_INDEX}, o as (select lane, segment, size_bytes as s, row_number() over (partition by lane order by low) as n from idx),
        fold(lane, n, filled, roll, mine) as (select distinct lane, 0::bigint, 0::bigint, 0::bigint, 0::bigint from idx union all
            select o.lane, o.n, case when filled + s >= {ROLL_BYTES} then 0 else filled + s end, case when filled + s >= {ROLL_BYTES} then roll + 1 else roll end, roll
            from fold join o on o.lane = fold.lane and o.n = fold.n + 1)
        select segment, mine as roll from fold join o using (lane, n)""",
    "store_stats": f"with {_STATE} select {_stats(segments.STATES)} from st",
    "ingest_stats": f"with {_STATE}, s2 as (select * replace (case when state = 'reading' then 'pending' else state end as state) from st) select {_stats(('active', 'flushed', 'pending'))} from s2",
    "retention_trash": f"with {_INDEX} select segment from idx where substr(high, 1, 10) < '{U.encode_ms(OLDEST_MS)}'",
    "retention_purge": f"with {_STATE} select segment from st where state = 'trashed' and trashed_ms < {OLDEST_MS}",
    "oldest_flushed": f"with {_STATE} select segment, trashed_ms as modified_ms from st where state = 'flushed' order by trashed_ms, segment limit 1",
    "human_size": """select seg_no, case when size > 1000000000 then (size // 1000000000)::varchar || ' GB' when size > 1000000 then (size // 1000000)::varchar || ' MB'
        when size > 1000 then (size // 1000)::varchar || ' kB' else size::varchar || ' Bytes' end as text from read_segments where size >= 0""",
    "recovered_index": """with r as (select batch_id, string_split(record, ' ')[1] as t from merge_records), s as (select batch_id, upper(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(65279))) as u from r)
        select batch_id, min(u) as low, max(u) as high, count(*) as n_records from s where regexp_full_match(u, '[0-7][0-9A-HJKMNP-TV-Z]{25}') group by batch_id""",
    "batch_outcomes": """select peer_type, coalesce(outcome, 'pending') as outcome, count(*) as n, max(epoch_us(closed_at)//1000 - epoch_us(opened_at)//1000) as longest_ms
        from batches join peers using (peer_id) group by 1, 2""",
    "topic_validate": f"""with {REC}, v as (select event_id, case event_id % 3 when 0 then '~' || body when 1 then replace(body, ' ', '') else body end as value from rec),
        t as (select event_id, case when instr(value, ' ') > 0 then string_split(value, ' ')[1] end as topic from v)
        select event_id, topic, coalesce(regexp_full_match(topic, '[a-zA-Z0-9][a-zA-Z0-9_-]*'), false) as topic_ok from t""",
    "topic_static": f"with {REC} select event_id, 'events-a ' || payload as body from rec",
    "forward_prefix": f"with {REC} select event_id, 'web eu ' || payload as value from rec",
    "live_query_fanout": f"with {REC}, q(query, q) as (values ('errors', 'error'), ('ones', '\"k\": 1'), ('most', 'e')) select query, ulid from rec join q on contains(body, q)",
    "logs_by_hour": f"with {REC} select topic, ms // 3600000 as hour, count(*) as n, count(distinct json_extract_string(payload, '$.k')) as n_k from rec group by 1, 2",
    "stream_grep": f"with {REC} select ulid, body from rec where contains(body, 'error')",
    "stream_tail": f"with {REC} select ulid, body || ' #1' as body from rec where contains(body, 'error') and ms < (select max(ms) from rec where contains(body, 'error')) - 3600000",
    "stream_by_hour": f"with {REC} select ms // 3600000 as hour, topic, 2 * count(*) as n from rec where (ms // 3600000 + 1) * 3600000 <= (select max(ms) from rec) - 3600000 group by 1, 2",
    "logs_sessions": """with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events),
        s as (select user_id, ts, sum(case when p is null or ts - p >= interval 6 hours then 1 else 0 end) over (partition by user_id order by ts, p rows unbounded preceding) as k from e)
        select user_id, epoch_us(min(ts)) // 1000 as start_ms, count(*) as n from s group by user_id, k""",
}

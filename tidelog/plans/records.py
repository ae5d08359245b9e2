"""Queries on merge_records and read_segments: deliveries, log entries, rows that fail, periods and small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ulid as U
from tidelog.functions.scale import shared_dir, spread, written
from tidelog.operators import compact, dedup, load, logparse, periods, segments
from tidelog.plans.logs import REC
from tidelog.sources import files
from tidelog.sources.tables import event_records, table


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Columns of merge_records, to be parsed."""
    return spread(table(spark, folder, "merge_records").select(*columns))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every loading row that is not the kept copy of its message; batches are taken in one range after the other."""
    raw = table(spark, folder, "merge_records")
    rows = load.loaded(records(spark, folder, "row_id", "src", "id", "record", "batch_id"), table(spark, folder, "topics"))
    return dedup.superseded(rows.select("ulid", "src", "row_id", dedup.epoch_of(raw, "batch_id").cast("int").alias("epoch")))


def log_entries(spark: SparkSession, folder: str, message: bool = True) -> DataFrame:
    """One row per entry of the log topics, over kept copies: conn_id, topic, ulid, ts_ms, log_level, component, (message,) n_lines."""
    rows = load.loaded(records(spark, folder, "row_id", "src", "conn_id", "id", "record"), table(spark, folder, "topics"))
    is_log = F.col("form") == "log"
    rows = logparse.parsed(rows.withColumn("body", F.when(is_log, F.col("body"))).withColumn("ulid_ms", U.ulid_ms(F.col("ulid"))))
    fields = ["ts_ms", "log_level", "component", *(["message"] if message else [])]
    starts = F.col("entry.ts_ms").isNotNull()
    entry = F.when(starts, F.struct(*[F.col(f"entry.{f}").alias(f) for f in fields])).alias("entry")
    text = [F.when(~F.coalesce(starts, F.lit(False)), F.col("body")).alias("text")] if message else []
    # other topics' copies settle who is kept too, by identifier alone
    mine = lambda c: F.when(is_log, F.col(c)).alias(c)
    rows = rows.select("ulid", "src", "row_id", mine("conn_id"), mine("topic"), is_log.alias("is_log"), entry, *text)
    lines = dedup.settled(rows, "is_log", "lines").withColumn("ulid_ms", U.ulid_ms(F.col("ulid")))
    return logparse.entries(lines, ("conn_id", "topic"), "ulid", "ulid_ms", text="text" if message else None)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per log entry: id of its first line, its time, level and component, and its number of lines."""
    return log_entries(spark, folder, message=False).select(F.col("ulid").alias("id"), "ts_ms", "log_level", "component", F.col("n_lines").cast("bigint").alias("n_lines"))


def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found with connection, topic and message (with the text of all its lines)."""
    return log_entries(spark, folder).withColumnRenamed("ulid", "id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of merge_records that cannot be loaded, and why."""
    return load.rejected(records(spark, folder, "row_id", "id", "record"), table(spark, folder, "topics"))


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that load, taken apart."""
    rows = load.loaded(records(spark, folder, "row_id", "id", "record"), table(spark, folder, "topics"))
    return rows.select("row_id", "ulid", "topic", F.col("body").alias("payload"))


def p4_table(topic: str):
    """A query: the loaded table of a topic, with times in microseconds, dates as text and decimals as doubles (for comparison with other engines)."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        d = load.loaded_table(records(spark, folder, "row_id", "id", "record"), table(spark, folder, "topics"), topic).drop("ulid")
        plain = {"timestamp": lambda c: F.unix_micros(c), "date": lambda c: c.cast("string"), "decimal(38,18)": lambda c: c.cast("double")}
        return d.select(*[plain.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in d.dtypes])

    return query


def live_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that a query may read, as a table: it is read more than once."""
    return written(segments.live(table(spark, folder, "read_segments")), "live")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of the live segment files of each volume, and the gaps between them."""
    return periods.periods(live_files(spark, folder).select(F.col("volume").alias("entity"), "low", "high")).withColumnRenamed("entity", "volume")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The live files that are put together."""
    return p5_plan(spark, folder).select("volume", "low", "high")


def p5_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The output file of each live file that is put together."""
    return compact.plan(live_files(spark, folder))


def p5_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row on p5_plan: files that are put together, whether each is in one output, whether every output is within the target, and whether the outputs
    are as few as the bytes of their part need, and no more than a fifth and one above."""
    d = written(p5_plan(spark, folder), "plan")
    of = d.groupBy("volume", "part", "output").agg(F.sum("size").alias("size"))
    parts = of.groupBy("volume", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    few = F.col("n") <= F.ceil(F.col("size") / compact.TARGET) * 1.2 + 1
    r = parts.agg(F.bool_and(few).alias("few")).first(), of.agg(F.bool_and(F.col("size") <= compact.TARGET).alias("fits")).first()
    n = d.select("volume", "low", "high").distinct().count()
    return d.agg(F.count(F.lit(1)).alias("n_files")).select("n_files", (F.col("n_files") == n).alias("once"), F.lit(r[1].fits).alias("fits"), F.lit(r[0].few).alias("few"))


def p5_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """End to end: events in many small files of five volumes, listed, planned, rewritten, published and read again; the records of the manifest's files."""
    base = shared_dir(spark, "volumes")
    e = event_records(spark, folder).select("ulid", "raw", "event_id")
    listing = None
    for k in range(5):
        volume = f"{base}/vol-{k:07d}"
        written(files.write(e.where(F.col("event_id") % 5 == k), volume, SMALL_BYTES), "small")
        seen = files.listing(spark, volume).select(F.concat(F.lit("file://" if base.startswith("file:") else ""), "path").alias("path"), F.col("size_bytes").alias("size"))
        listing = seen if listing is None else listing.unionByName(seen)
    listing = listing.withColumn("seg_no", F.monotonically_increasing_id()).withColumn("listed_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = compact.plan(segments.live(listing, with_path=True), target=16 * SMALL_BYTES)
    out = f"{base}/out"
    compact.consolidate(compact.output_name(plan), out, "lines")
    names = [f"{out}/{r.file}" for r in compact.published(spark, out).select("file").collect()]  # one row an output file
    lines = spark.read.option("lineSep", "\n").text(names) if names else spark.createDataFrame([], "value string")
    return files.take_apart(lines).select("ulid", "body")


SMALL_BYTES = 2 << 10

# --- the same in SQL, for the tables' six layouts -------------------------------------------------------------------

_ULID = "[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}"
_AROUND = "[\\s\\x{FEFF}\\x{00A0}\\x{200B}]"
_AT, _DAY, _INT, _DEC, _TEXT, _WORD, _BOOL = r"\d{4}-\d\d-\d\dT(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?Z", r"\d{4}-\d\d-\d\d", r"-?\d{1,18}", r"-?\d+(?:\.\d+)?", '(?:[^",]+|"(?:[^"]|"")+")', '(?:[^",\\s]+)', "(?:true|false)"
_CSV = {
    "metrics": f"{_AT},{_WORD},{_WORD},{_DEC},{_TEXT}?",
    "audit": f"{_AT},{_WORD},{_WORD},{_TEXT},{_INT}",
    "tickets": f"{_INT},{_DAY},{_TEXT},(?:{_DEC})?,{_WORD}?,{_TEXT}?",
    "probe": f"{_AT},{_WORD},{_BOOL},{_INT}",
}
_JSON = {
    "orders-feed": {"seq": ("int", _INT), "sku": ("string", ".+"), "qty": ("int", _INT), "price": ("number", _DEC), "placed": ("string", _AT)},
    "profile_log": {"user": ("int", _INT), "display": ("string", ".+"), "active": ("bool", _BOOL), "joined": ("string", _DAY)},
}
# What the SQL engine calls the types of JSON values.
_KINDS = {"int": "('BIGINT', 'UBIGINT')", "number": "('BIGINT', 'UBIGINT', 'DOUBLE')", "string": "('VARCHAR')", "bool": "('BOOLEAN')"}
_NO_DAY = "try_cast(regexp_extract(body, '\\d{4}-\\d\\d-\\d\\d') as date) is null"  # each layout has one date or time
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _reason_sql() -> str:
    out = []
    for topic, good in _CSV.items():
        n = len(_columns(good))
        out.append(f"when topic = '{topic}' then case when not regexp_full_match(body, '{_FIELD}(?:,{_FIELD})*') then 'quoting' when not regexp_full_match(body, '{_FIELD}(?:,{_FIELD}){{{n - 1}}}') then 'columns' when not regexp_full_match(body, '{good}') or {_NO_DAY} then 'value' end")
    for topic, keys in _JSON.items():
        names = "[" + ", ".join(f"'{k}'" for k in sorted(keys)) + "]"
        fine = " and ".join(f"json_type(body, '$.{k}') in {_KINDS[kind]} and regexp_full_match(json_extract_string(body, '$.{k}'), '{form}')" for k, (kind, form) in keys.items())
        out.append(f"when topic = '{topic}' then case when not json_valid(body) then 'quoting' when list_sort(json_keys(body)) != {names} then 'columns' when not coalesce({fine}, false) or {_NO_DAY} then 'value' end")
    return "case " + " ".join(out) + " end"


def _columns(pattern: str) -> list[str]:
    """A CSV pattern by its columns: commas inside classes and groups part none."""
    out, depth = [""], 0
    for ch in pattern:
        depth += (ch in "([{") - (ch in ")]}")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


# The tables' layouts, as far as the SQL below needs them: name and type of each column.
_LAYOUTS = {
    "metrics": "at:timestamp,host:word,name:word,value:decimal,note:text",
    "audit": "at:timestamp,actor:word,action:word,target:text,status:int",
    "tickets": "ticket:int,opened:date,title:text,cost:decimal,owner:word,notes:text",
    "probe": "at:timestamp,target:word,ok:bool,ms:int",
    "orders-feed": "seq:int,sku:text,qty:int,price:decimal,placed:timestamp",
    "profile_log": "user:int,display:text,active:bool,joined:date",
}


def _table_sql(topic: str) -> str:
    columns = [c.split(":") for c in _LAYOUTS[topic].split(",")]
    if topic in _CSV:
        groups = ",".join(f"({c})" for c in _columns(_CSV[topic]))
        texts = f"regexp_extract(body, '^{groups}$', [{', '.join(repr(n) for n, _ in columns)}])"
        value = lambda n: f"nullif(case when starts_with(f['{n}'], '\"') then replace(substr(f['{n}'], 2, len(f['{n}']) - 2), '\"\"', '\"') else f['{n}'] end, '')"
    else:
        texts, value = "body", lambda n: f"json_extract_string(body, '$.{n}')"
    form = {"timestamp": "epoch_us(cast({} as timestamptz))", "int": "cast({} as bigint)", "decimal": "cast({} as double)", "bool": "cast({} as boolean)"}
    got = ", ".join(f'{form.get(k, "{}").format(value(n))} as "{n}"' for n, k in columns)
    return f"with {_ROWS}, t2 as (select row_id, body, {texts} as f from rows where reason is null and topic = '{topic}') select row_id, {got} from t2"


_ROWS = f"""r as (select row_id, src, id, regexp_replace(regexp_replace(record, '^{_AROUND}+', ''), '\\r?\\n$|\\r$', '') as l from merge_records),
    s as (select *, instr(l, ' ') as a from r),
    t as (select *, upper(regexp_replace(case when a > 0 then substr(l, 1, a - 1) else l end, '{_AROUND}+$', '')) as u, case when a > 0 then substr(l, a + 1) end as rest from s),
    x as (select *, case when instr(rest, ' ') > 0 then substr(rest, 1, instr(rest, ' ') - 1) end as topic, case when instr(rest, ' ') > 0 then substr(rest, instr(rest, ' ') + 1) end as body from t),
    y as (select *, {_reason_sql()} as pay from x),
    rows as (select row_id, src, u, topic, body, case when topic is null then 'columns' when pay in ('quoting', 'columns') then pay when not regexp_full_match(u, '{_ULID}')
        or (id is not null and upper(regexp_replace(regexp_replace(id, '^{_AROUND}+', ''), '{_AROUND}+$', '')) != u) or not regexp_full_match(topic, '[a-zA-Z0-9][a-zA-Z0-9_-]*') then 'value' else pay end as reason from y)"""
_FILES = f"""raw as (select seg_no, listed_at, size, replace(regexp_replace(regexp_replace(path, '^{_AROUND}+', ''), '{_AROUND}+$', ''), chr(92), '/') as p from read_segments),
    parts as (select *, lower(regexp_extract(p, '(?i)(?:^|/)(vol-[0-9]{{7}})/', 1)) as volume, regexp_extract(string_split(p, '/')[-1], '^({_ULID})-({_ULID})\\.([A-Za-z]+)$', ['a', 'b', 's']) as n from raw),
    named as (select *, least(upper(n.a), upper(n.b)) as low, greatest(upper(n.a), upper(n.b)) as high, lower(n.s) as state from parts where n.a != '' and volume != ''),
    cur as (select volume, low, high, arg_max(state, (listed_at, seg_no)) as state, arg_max(size, (listed_at, seg_no)) filter (size >= 0) as size from named group by all),
    live as (select * from cur where state in ('flushed', 'reading'))"""
SQL = {
    "p1_found": f"with {_ROWS} select row_id from (select row_id, row_number() over (partition by u order by src, row_id) as k from rows where reason is null) where k > 1",
    "p2_found": f"""with {_FILES}, m as (select volume, low, high, max(high) over (partition by volume order by low, high rows between unbounded preceding and 1 preceding) as b from live),
        g as (select *, sum(case when b is null or low > b then 1 else 0 end) over (partition by volume order by low, high rows unbounded preceding) as k from m),
        p as (select volume, k, min(low) as low, max(high) as high from g group by volume, k)
        select volume, 'period' as kind, low, high from p union all
        select volume, 'gap', high, n from (select volume, high, lead(low) over (partition by volume order by k) as n from p) where n is not null""",
    "p4_found": f"with {_ROWS} select row_id, reason from rows where reason is not null",
    "p4_loaded": f"with {_ROWS} select row_id, u as ulid, topic, body as payload from rows where reason is null",
    **{f"p4_table_{t.replace('-', '_')}": _table_sql(t) for t in _LAYOUTS},
    "p5_consolidated": f"with {REC} select ulid, body from rec",
    "p5_found": f"with {_FILES} select volume, low, high from live where size < 16777216 qualify count(*) over (partition by volume) > 1",
}
SQL["p5_check"] = f"select count(*) as n_files, true as once, true as fits, true as few from ({SQL['p5_found']}) f"
QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_entries, p4_found, p4_loaded, p5_found, p5_plan, p5_check, p5_consolidated)} | {f"p4_table_{t.replace('-', '_')}": p4_table(t) for t in _LAYOUTS}

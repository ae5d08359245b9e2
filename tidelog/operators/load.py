"""Rows that fail to parse: load the valid records, and set the others apart with a reason.

Method: the identifier, topic and shape of a record are JVM expressions. Payloads with a layout go, topic by topic, as
whole blocks through pyarrow's CSV and JSON readers; a block that does not parse, or whose columns break their types,
is halved again and again until its bad records stand alone, and each of those is then diagnosed strictly, character by
character. A row's result depends on that row only, so there is no shuffle, and any split of the input gives the same. The columns
that the block reader has made are the loaded table of a topic (loaded_table).
"""

from __future__ import annotations

import json
import re
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ulid as U

MAX_TOPICS = 10_000
BLOCK = 4_096
LEAF = 12

# Topic grammar, and the text form of each type (RFC 3339, ISO dates, integers, decimals, booleans, words).
TOPIC = r"[a-zA-Z0-9][a-zA-Z0-9_-]*"
FORMS = {
    "timestamp": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)",
    "date": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])",
    "int": r"[+-]?\d+",
    "decimal": r"[+-]?(\d+(\.\d+)?|\.\d+)",
    "bool": r"true|false",
    "word": r"\S+",
    "text": r"(?s).*",
}
_RE2 = {k: f"^(?:{v})$" for k, v in FORMS.items()}
_CSV_ROW = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', re.S)
_CSV_SHAPE = r'^(?s:(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*)$'


class Layout:
    """Columns of a topic: 'name:type,...'; a type that ends in '?' may be empty, any other may not."""

    def __init__(self, text: str):
        pairs = [c.rsplit(":", 1) for c in text.split(",")]
        self.names = [n for n, _ in pairs]
        self.types = [t.rstrip("?") for _, t in pairs]
        self.optional = [t.endswith("?") for _, t in pairs]
        if bad := set(self.types) - set(FORMS):
            raise ValueError(f"unknown types {sorted(bad)}")
        self.usual = {"csv": self._usual_csv(), "json": self._usual_json()}

    def _usual_csv(self) -> str:
        """Pattern of most good CSV payloads."""
        columns = []
        for kind, optional in zip(self.types, self.optional):
            bare = {"text": '[^",]+', "word": '[^",\\s]+'}.get(kind, FORMS[kind])
            quoted = '(?:[^"]|"")+' if kind in ("text", "word") else FORMS[kind]
            columns.append(f'(?:{bare}|"(?:{quoted})"){"?" * optional}')
        return "^" + ",".join(columns) + "$"

    def _usual_json(self) -> str:
        """Pattern of most good JSON payloads."""
        one = []
        for name, kind in zip(self.names, self.types):
            value = {"text": r'"(?:[^"\\]|\\.)+"', "word": r'"[^"\\\s]+"', "decimal": r"-?\d+(?:\.\d+)?", "int": r"-?\d{1,18}", "bool": "true|false"}.get(kind) or f'"{FORMS[kind]}"'
            one.append(f'"{re.escape(name)}"\\s*:\\s*(?:{value})')
        pair = f"(?:{'|'.join(one)})"
        return rf"^\{{{pair}(?:,\s*{pair}){{{len(one) - 1}}}\}}$"


def is_value(text: str, kind: str) -> bool:
    """Whether a text is of a type; also checks what a pattern can't: calendar days and 64 bits."""
    if not re.fullmatch(FORMS[kind], text, re.ASCII if kind != "word" else 0):
        return False
    if kind == "int":
        return -(1 << 63) <= int(text) < 1 << 63
    if kind in ("timestamp", "date"):
        try:
            date.fromisoformat(text[:10])
        except ValueError:
            return False
    return True


def read_csv_row(payload: str, layout: Layout) -> str | list[str]:
    """Strict reading of one CSV payload: its fields, or the reason it is bad."""
    if not _CSV_ROW.fullmatch(payload):
        return "quoting"
    fields, at, quoted = [""], 0, False
    while at < len(payload):
        ch = payload[at]
        if quoted and payload.startswith('""', at):
            fields[-1] += '"'
            at += 1
        elif ch == '"':
            quoted = not quoted
        elif ch == "," and not quoted:
            fields.append("")
        else:
            fields[-1] += ch
        at += 1
    if len(fields) != len(layout.names):
        return "columns"
    for value, kind, optional in zip(fields, layout.types, layout.optional):
        if not (optional and value == "") and not (is_value(value, kind) and (value or optional)):
            return "value"
    return fields


class _Number(str):
    """A JSON number as it is written."""


def read_json_row(payload: str, layout: Layout) -> str | list[str]:
    """Strict reading of one JSON payload: its values as text in the layout's order ('' for null), or the reason it is bad.

    Keys given twice count as a wrong number of keys.
    """
    if not payload.strip():
        return "columns"
    try:
        pairs = json.loads(payload, object_pairs_hook=lambda x: ("object", x), parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return "quoting"
    if not isinstance(pairs, tuple):
        return "columns"
    keys = [k for k, _ in pairs[1]]
    if len(keys) != len(layout.names) or set(keys) != set(layout.names):
        return "columns"
    got = dict(pairs[1])
    for name, kind, optional in zip(layout.names, layout.types, layout.optional):
        v = got[name]
        if v is None:
            fine = optional
        elif kind == "bool":
            fine = isinstance(v, bool)
        elif kind == "int":
            fine = isinstance(v, _Number) and is_value(v, "int")
        elif kind == "decimal":
            fine = isinstance(v, _Number)
        else:
            fine = type(v) is str and is_value(v, kind) and (v != "" or optional)
        if not fine:
            return "value"
    return ["" if got[n] is None else str(got[n]).lower() if k == "bool" else str(got[n]) for n, k in zip(layout.names, layout.types)]


def diagnose(payload: str, form: str, layout: Layout) -> str | None:
    """The reason that one payload is bad, or None."""
    got = (read_csv_row if form == "csv" else read_json_row)(payload, layout)
    return got if isinstance(got, str) else None


def _refuse(text: str) -> None:
    raise ValueError(text)


def _all(mask: pa.ChunkedArray | pa.Array) -> bool:
    return pc.all(mask, min_count=0).as_py() is True


def _forms_hold(column: pa.ChunkedArray, kind: str, optional: bool) -> bool:
    """Every value of a column of text has its type's form; what a pattern can't tell is tested by a cast."""
    if optional:
        column = column.filter(pc.not_equal(column, ""))
    elif not _all(pc.not_equal(column, "")):
        return False
    if not _all(pc.match_substring_regex(column, _RE2[kind])):
        return False
    if kind == "int":
        column.cast(pa.int64())
    elif kind in ("timestamp", "date"):
        pc.utf8_slice_codeunits(column, 0, 10).cast(pa.date32())
    return True


def _csv_block(block: pa.Array, layout: Layout) -> pa.Table | None:
    """A whole block of CSV payloads by the columnar reader, every column as text; None if one of them is bad."""
    if not _all(pc.match_substring_regex(block, _CSV_SHAPE)) or _all(pc.equal(block, "")):
        return None
    data = pc.binary_join(pa.ListArray.from_arrays([0, len(block)], block), "\n")[0].as_py().encode()
    t = pv.read_csv(
        pa.BufferReader(data),
        read_options=pv.ReadOptions(column_names=layout.names, use_threads=False, block_size=max(len(data) + 1, 1 << 16)),
        parse_options=pv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False),
        convert_options=pv.ConvertOptions(column_types=dict.fromkeys(layout.names, pa.string()), strings_can_be_null=False),
    )
    return t if t.num_rows == len(block) and all(_forms_hold(t[n], k, o) for n, k, o in zip(layout.names, layout.types, layout.optional)) else None


# The JSON reader's type for each type of a layout.
_JSON_TYPES = {"int": pa.int64(), "decimal": pa.float64(), "bool": pa.bool_()}


def _has_each_key_once(block: pa.Array, layout: Layout) -> pa.Array:
    """Of each JSON payload whether it shows each key just once. Without its escapes, a quote and a colon are in an object's keys only; a
    key that is spelled otherwise (escaped, or with a space before the colon) counts as not shown."""
    bare = pc.replace_substring_regex(block, r"\\.", "")
    out = pa.array([True] * len(block), pa.bool_())
    for name in layout.names:
        out = pc.and_(out, pc.equal(pc.count_substring(bare, f'"{name}":'), 1))
    return out


def _json_block(block: pa.Array, layout: Layout) -> pa.Table | None:
    """A whole block of JSON payloads (each with each key once) by the columnar reader; None if one of them is bad."""
    if not _all(pc.starts_with(block, "{")):
        return None
    data = pc.binary_join(pa.ListArray.from_arrays([0, len(block)], block), "\n")[0].as_py().encode()
    schema = pa.schema([(n, _JSON_TYPES.get(k, pa.string())) for n, k in zip(layout.names, layout.types)])
    t = pj.read_json(pa.BufferReader(data), read_options=pj.ReadOptions(use_threads=False, block_size=len(data) + 1), parse_options=pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="error"))
    if t.num_rows != len(block):
        return None
    for name, kind, optional in zip(layout.names, layout.types, layout.optional):
        if not optional and t[name].null_count:
            return None
        if kind not in _JSON_TYPES and not _forms_hold(t[name].drop_null(), kind, optional):
            return None
    return t


def bisect(block: pa.Array, good, diagnose, keep=None) -> dict[int, str]:
    """Reasons by position in the block. good(block) is the fast test of a whole block (false or None where a record is bad),
    diagnose(text) the strict one of a record. keep(low, high, result) is told of each good block, keep(k, None, text) of good single records."""
    reasons: dict[int, str] = {}
    stack = [(0, len(block))]
    while stack:
        lo, hi = stack.pop()
        if lo >= hi:
            continue
        try:
            got = good(block[lo:hi])
        except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError):
            got = None
        if got is not None and got is not False:
            if keep:
                keep(lo, hi, got)
        elif hi - lo <= LEAF:
            for k in range(lo, hi):
                if reason := diagnose(block[k].as_py()):
                    reasons[k] = reason
                elif keep:
                    keep(k, None, block[k].as_py())
        else:
            mid = (lo + hi) // 2
            stack += [(mid, hi), (lo, mid)]
    return reasons


def _columns_of(table: pa.Table, layout: Layout, raw: pa.Array) -> list[pa.Array]:
    """A block's columns as text, null where empty. Decimals of JSON are taken from the payload: the reader's would be binary fractions."""
    out = []
    for name, kind in zip(layout.names, layout.types):
        c = table[name].combine_chunks()
        if kind == "decimal" and pa.types.is_floating(c.type):
            bare = pc.replace_substring_regex(raw, r"\\.", "")
            c = pc.struct_field(pc.extract_regex(bare, rf'"{re.escape(name)}":\s*(?P<v>-?[0-9.eE+-]+|null)'), "v")
            c = pc.if_else(pc.equal(c, "null"), None, c)
        elif not pa.types.is_string(c.type):
            c = c.cast(pa.string())
        out.append(pc.if_else(pc.equal(c, ""), None, c))
    return out


def payload_columns(payload: pa.Array, form: str, layout: Layout, values: bool = True) -> tuple[pa.Array, list[pa.Array]]:
    """Of payloads of one topic: the reason of each bad one, and the columns of the good ones as text (null where empty, or bad).

    Null payloads have neither. values: whether the columns are wanted.
    """
    n = len(payload)
    reasons: list[str | None] = [None] * n
    pieces: list[tuple[np.ndarray, list[pa.Array]]] = []
    read = (lambda x: read_csv_row(x, layout)) if form == "csv" else (lambda x: read_json_row(x, layout))

    def one(row: int, text: str) -> None:
        got = read(text)
        if isinstance(got, str):
            reasons[row] = got
        elif values:
            singles[0].append(row)
            singles[1].append([v or None for v in got])

    singles: tuple[list, list] = ([], [])
    rows = np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False))
    mine = payload.take(pa.array(rows))
    # more than one line isn't for blocks of lines, nor are keys that can't be counted
    strict = pc.match_substring_regex(mine, r"[\r\n]")
    if form == "json":
        strict = pc.or_(strict, pc.invert(_has_each_key_once(mine, layout)))
    strict = strict.to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(strict).tolist():
        one(int(rows[k]), mine[k].as_py())
    usual = pc.match_substring_regex(mine, layout.usual[form]).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(~strict & usual), np.flatnonzero(~strict & ~usual)])
    rows, mine = rows[order], mine.take(pa.array(order))
    good = (lambda b: _csv_block(b, layout)) if form == "csv" else (lambda b: _json_block(b, layout))
    ends = sorted({*range(0, len(mine), BLOCK), int((~strict & usual).sum()), len(mine)})
    for at, end in zip(ends, ends[1:]):

        def keep(lo: int, hi: int | None, got, at: int = at) -> None:
            if hi is None:
                one(int(rows[at + lo]), got)
            else:
                pieces.append((rows[at + lo : at + hi], _columns_of(got, layout, mine[at + lo : at + hi])))

        for k, reason in bisect(mine[at:end], good, lambda x: diagnose(x, form, layout), keep if values else None).items():
            reasons[rows[at + k]] = reason
    if singles[0]:
        pieces.append((np.array(singles[0]), [pa.array(c, pa.string()) for c in zip(*singles[1])]))
    if not values:
        return pa.array(reasons, pa.string()), []
    # where each row's values are in the pieces
    place = np.full(n, -1, np.int64)
    if pieces:
        place[np.concatenate([p[0] for p in pieces])] = np.arange(sum(len(p[0]) for p in pieces))
    where = pa.array(place, mask=place < 0)
    columns = [pa.concat_arrays([p[1][k] for p in pieces]).take(where) if pieces else pa.nulls(n, pa.string()) for k in range(len(layout.names))]
    return pa.array(reasons, pa.string()), columns


def payload_reasons(topic: pa.Array, payload: pa.Array, layouts: dict[str, tuple[str, Layout]]) -> pa.Array:
    """Reason of each payload, null where it is good; rows with a null topic or payload, and topics without layout, are not looked at."""
    out = np.full(len(payload), None, object)
    for name in pc.unique(topic).to_pylist():
        if name in layouts:
            rows = pc.indices_nonzero(pc.fill_null(pc.equal(topic, name), False))
            out[rows.to_numpy()] = payload_columns(payload.take(rows), *layouts[name], values=False)[0].to_pylist()
    return pa.array(out, pa.string())


def read_layouts(topics: DataFrame) -> tuple[dict[str, str], dict[str, tuple[str, Layout]]]:
    """Topics and the layouts of those that have one. The table holds topics, not records; more than MAX_TOPICS rows are refused."""
    rows = topics.select("topic", "payload", "layout").where("topic is not null").limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    return {r.topic: r.payload for r in rows}, {r.topic: (r.payload, Layout(r.layout)) for r in rows if r.layout and r.payload in ("csv", "json")}


def _taken_apart(records: DataFrame, forms: dict[str, str]) -> DataFrame:
    """records with ulid, topic, body and form, and _whole: whether topic and payload are there."""
    kind = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]) if forms else F.create_map(F.lit(""), F.lit(""))
    line = F.regexp_replace(F.regexp_replace("record", f"^{U.AROUND}+", ""), "\r?\n\\z|\r\\z", "")
    d = records.drop("ulid", "topic", "body", "form", "reason").withColumn("_line", line)
    d = d.withColumn("_one", F.instr("_line", " "))
    d = d.withColumn("_rest", F.when(F.col("_one") > 0, F.regexp_replace(F.expr("substring(_line, _one + 1)"), f"^{U.AROUND}+", "")))
    d = d.withColumn("_two", F.instr("_rest", " "))
    d = d.withColumn("_whole", F.coalesce(F.col("_two") > 0, F.lit(False)))
    d = d.withColumn("ulid", U.normal_ulid(F.when(F.col("_one") > 0, F.substring_index("_line", " ", 1)).otherwise(F.col("_line"))))
    d = d.withColumn("topic", F.when(F.col("_whole"), F.substring_index("_rest", " ", 1)))
    d = d.withColumn("body", F.when(F.col("_whole"), F.expr("substring(_rest, _two + 1)")))
    return d.withColumn("form", F.element_at(kind, F.col("topic"))).drop("_line", "_one", "_rest", "_two")


def _reason(payload: Column) -> Column:
    """Reason of a record that is taken apart, given that of its payload."""
    same = F.col("id").isNull() | F.coalesce(U.normal_ulid(F.col("id")) == F.col("ulid"), F.lit(False))
    value = F.col("ulid").isNull() | ~same | ~F.col("topic").rlike(f"^{TOPIC}\\z")
    return F.when(~F.col("_whole"), "columns").when(payload.isNotNull() & (payload != "value"), payload).when(value, "value").otherwise(payload)


def load(records: DataFrame, topics: DataFrame) -> DataFrame:
    """All rows of records with ulid, topic, body, form ('log', 'csv', 'json', null for an unknown topic) and reason (null: it loads).

    records needs `id` and `record`; columns of the names above are replaced, any others stay. Reasons are 'quoting',
    'columns' and 'value', the first that applies in this order. A null record lacks topic and payload ('columns'); a null
    id is none to compare; an empty payload is fine for log topics and has no columns elsewhere ('columns'); the payload
    of a topic without layout is not checked. Empty tables give empty results; repeated rows get the same result each.
    """
    forms, layouts = read_layouts(topics)

    @F.arrow_udf("string")
    def payload_reason(topic: pa.Array, payload: pa.Array) -> pa.Array:
        return payload_reasons(topic, payload, layouts)

    d = _taken_apart(records, forms)
    checked = F.col("form").isin("csv", "json")
    # else a filter on the reason would be pushed below, and the function called once for each mention
    d = d.withColumn("_payload", payload_reason.asNondeterministic()(F.when(checked, F.col("topic")), F.when(checked, F.col("body"))))
    return d.withColumn("reason", _reason(F.col("_payload"))).drop("_whole", "_payload")


def rejected(records: DataFrame, topics: DataFrame) -> DataFrame:
    """row_id and reason of every row that does not load."""
    return load(records.select("row_id", "id", "record"), topics).where("reason is not null").select("row_id", "reason")


def loaded(records: DataFrame, topics: DataFrame) -> DataFrame:
    """The rows that load, with ulid, topic, body and form."""
    return load(records, topics).where("reason is null").drop("reason")


def _typed(text: Column, kind: str) -> Column:
    """A value of a type's form as that type; a leap second is the second after the one before it."""
    if kind == "timestamp":
        at = F.regexp_replace(text, r"^(.{17})60", "$159").try_cast("timestamp")
        return F.when(F.substring(text, 18, 2) == "60", at + F.expr("interval 1 second")).otherwise(at)
    return text.try_cast({"date": "date", "int": "bigint", "decimal": "decimal(38,18)", "bool": "boolean"}.get(kind, "string"))


def loaded_table(records: DataFrame, topics: DataFrame, topic: str) -> DataFrame:
    """The rows of one topic that load, as a table: the columns of records (but id and record), ulid, and the layout's columns in their types.

    Values come from the block reader (from the strict one for records that no block took). Timestamps are instants; decimals have 18 places, and one of
    more than 20 digits before the point is null, as are empty optional values. A topic without layout has the column `payload`. A
    layout's column that has a name in use already is preceded by the topic and a dot.
    """
    forms, layouts = read_layouts(topics)
    d = _taken_apart(records, forms).where(F.col("topic") == topic)
    keep = [c for c in d.columns if c not in ("id", "record", "topic", "form", "body", "_whole")]
    if topic not in layouts:
        return d.withColumn("reason", _reason(F.lit(None).cast("string"))).where("reason is null").select(*keep, F.col("body").alias("payload"))
    form, layout = layouts[topic]
    fields = [f"c{k}" for k in range(len(layout.names))]

    @F.arrow_udf(", ".join(f"{f} string" for f in ["reason", *fields]))
    def read(payload: pa.Array) -> pa.Array:
        reason, columns = payload_columns(payload, form, layout)
        return pa.StructArray.from_arrays([reason, *columns], names=["reason", *fields])

    d = d.withColumn("_p", read.asNondeterministic()(F.col("body")))
    d = d.withColumn("reason", _reason(F.col("_p.reason"))).where("reason is null")
    return d.select(*[F.col(c) for c in keep], *[_typed(F.col(f"_p.{f}"), k).alias(f"{topic}.{n}" if n in keep else n) for f, n, k in zip(fields, layout.names, layout.types)])

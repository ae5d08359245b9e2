"""Semi-structured log lines into fields: one row per entry with time, level, component and message.

Method: a deterministic character-level state machine, given as two tables (next state, and whether a token begins), walks
all lines of a batch in step, one character column at a time. Its tokens (words, numbers, dates and times, quoted strings,
brackets and delimiters) go through lookahead states, which tell lines that can begin an entry (a time or a key comes soon) from
continuations; the others are matched by grammars that name the time, level, component and message, those of known layouts first and
then a general one (a time near the beginning, and what stands around it). A line that fits none starts no entry. Continuations are
attached to the entry before them, which takes the order of lines: lines are put in shards by stream and hour, so that no stream is
one task's, and one row a shard settles what crosses shards.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, date, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.scale import written

SHARD_MS = 3_600_000

# --- the state machine -------------------------------------------------------------------------------------------------

# Character classes; every byte not named is a letter.
_CLASSES = ["end", "letter", "T", "digit", "space", '"', "\\", ":", "-", ".", "/", "+", ",", "=", "|", "[", "]", "{", "}", "(", ")", "<", ">", "@"]
_C = {c: k for k, c in enumerate(_CLASSES)}
_PUNCT = [",", "=", "|", "[", "]", "{", "}", "(", ")", "<", ">"]
# States are also the kinds of tokens: a token has the kind of the state at its last character.
_STATES = ["gap", "word", "number", "date", "time", "quote", "escape", "quoted", ":", *_PUNCT]
_S = {s: k for k, s in enumerate(_STATES)}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes = np.full(256, _C["letter"], np.uint8)
    for ch in _CLASSES[5:]:
        classes[ord(ch)] = _C[ch]
    classes[[ord(c) for c in "0123456789"]] = _C["digit"]
    classes[[ord(c) for c in "TZ"]] = _C["T"]
    classes[[ord(c) for c in " \t\r\n\v\f"]] = _C["space"]

    def fresh(c: str) -> str:
        """State after a character that begins something new."""
        return {"end": "gap", "space": "gap", "digit": "number", '"': "quote", ":": ":"}.get(c) or (c if c in _PUNCT else "word")

    go = np.zeros((len(_STATES), len(_CLASSES)), np.uint8)
    new = np.zeros((len(_STATES), len(_CLASSES)), bool)
    for s in _STATES:
        for c in _CLASSES:
            goes_on = None
            if s == "quote":
                goes_on = {'"': "quoted", "\\": "escape", "end": "gap"}.get(c, "quote")
            elif s == "escape":
                goes_on = "gap" if c == "end" else "quote"
            elif s in ("word", "number", "date", "time") and c not in ("end", "space", '"', "=", "|", *_PUNCT):
                if s == "word" or c in ("letter", "\\", "@"):
                    goes_on = "word"
                elif s == "time" or c == ":":
                    goes_on = "time"
                elif s == "number" and c == "digit":
                    goes_on = "number"
                elif s == "number" and c == "T":
                    goes_on = "word"
                else:
                    goes_on = "date"
            elif s == "time" and c == ",":
                goes_on = "time"  # a comma before the fraction
            go[_S[s], _C[c]] = _S[goes_on or fresh(c)]
            new[_S[s], _C[c]] = goes_on is None and fresh(c) != "gap"
    return classes, go, new


_CLASS_OF, _GO, _NEW = _tables()
_CELLS = 2_000_000


def tokenise(data: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Tokens of many lines: yields (rows, first, kind, begin, end) for blocks of lines of like length.

    rows are line numbers; tokens first[k]..first[k+1] are those of rows[k]; begin and end are byte positions in data.
    """
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        # lines of a block are at most twice as long as its shortest (or 64), and it has a bounded number of cells
        least = max(64, 2 * int(length[order[at]]))
        end = min(int(np.searchsorted(length[order], least, "right")), at + max(1, _CELLS // least))
        rows = order[at:end]
        at = end
        width = int(length[rows].max()) + 1
        column = np.arange(width)[:, None]
        inside = column < length[rows][None, :]
        where = np.minimum(start[rows][None, :] + column, max(len(data) - 1, 0))
        cls = np.where(inside, _CLASS_OF[data[where]], 0) if len(data) else np.zeros((width, len(rows)), np.uint8)
        state = np.empty((width, len(rows)), np.uint8)
        now = np.zeros(len(rows), np.uint8)
        for j in range(width):
            now = _GO[now, cls[j]]
            state[j] = now
        before = np.zeros_like(state)
        before[1:] = state[:-1]
        begins = _NEW[before, cls]
        gap = state == 0
        ends = np.zeros_like(begins)
        ends[:-1] = ~gap[:-1] & (begins[1:] | gap[1:])
        r, j = np.nonzero(begins.T)
        r2, j2 = np.nonzero(ends.T)
        offset = start[rows]
        first = np.searchsorted(r, np.arange(len(rows) + 1))
        yield rows, first, state[j2, r2], offset[r] + j, offset[r2] + j2 + 1


# --- lookahead --------------------------------------------------------------------------------------------------------------

# States over a line's first tokens: nothing seen that tells, may begin an entry, continues the one before.
_LOOKING, _MAY_BEGIN, _CONTINUES = 0, 1, 2
LOOK = 12  # no grammar below has its time or first key later


def _look_table() -> np.ndarray:
    """Next state by state and kind of token; the kind after the last one stands for the end of the line."""
    t = np.repeat(np.arange(3, dtype=np.uint8)[:, None], len(_STATES) + 1, 1)
    t[_LOOKING, [_S[k] for k in ("number", "date", "time", "{", "=")]] = _MAY_BEGIN
    t[_LOOKING, -1] = _CONTINUES
    return t


_LOOK = _look_table()


def may_begin(first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of each line (tokens first[k]..first[k+1]) whether it can begin an entry; all lines in step, a token at a time."""
    state = np.zeros(len(first) - 1, np.uint8)
    for j in range(LOOK):
        at = first[:-1] + j
        kind = np.where(at < first[1:], kinds[np.minimum(at, max(len(kinds) - 1, 0))] if len(kinds) else 0, len(_STATES))
        state = _LOOK[state, kind]
        if (state != _LOOKING).all():
            break
    return state == _MAY_BEGIN


# --- fields ------------------------------------------------------------------------------------------------------------

# Names of levels, by what they come to; numbers are those of JSON loggers (10 to 60) and syslog (0 to 7).
_LEVELS = {
    "DEBUG": ["debug", "dbg", "trace", "trc", "verbose", "fine", "finer", "finest", "d", "t", "v"],
    "INFO": ["info", "inf", "information", "informational", "notice", "note", "i", "n"],
    "WARN": ["warn", "warning", "wrn", "w"],
    "ERROR": ["error", "err", "e", "severe"],
    "FATAL": ["fatal", "ftl", "crit", "critical", "panic", "alert", "emerg", "emergency", "f", "c"],
}
LEVEL_OF = {name: level for level, names in _LEVELS.items() for name in names}
_NUMBERED = {10: "DEBUG", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
_SEVERITY = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
_MONTHS = {m: k for k, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], 1)}
# Keys of structured lines, the first that a line has counts.
_TIME_KEYS = ("ts", "time", "@timestamp", "timestamp", "t", "at", "date", "datetime", "asctime")
_LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "levelname", "sev")
_COMPONENT_KEYS = ("component", "logger", "name", "module", "service")
_PLACE_KEYS = ("program", "app", "caller", "source", "file")
_MESSAGE_KEYS = ("msg", "message", "event", "text")

_CLOCK = re.compile(r"(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?(?:(Z|z)|([+-])(\d\d):?(\d\d))?\Z")
_LAST_MS = 253_402_300_799_999  # in the year 9999; identifiers go on to 10889
_days: dict[tuple[int, int, int], int] = {}


def day_ms(year: int, month: int, day: int) -> int | None:
    """Epoch milliseconds of a day, None if there is no such day."""
    key = (year, month, day)
    if key not in _days:
        if len(_days) > 50_000:
            _days.clear()
        try:
            _days[key] = (date(year, month, day).toordinal() - 719_163) * 86_400_000
        except ValueError:
            return None
    return _days[key]


def clock_ms(text: str) -> int | None:
    """Milliseconds of a time of day in UTC (below 0 or above a day where the zone makes it so), cut."""
    m = _CLOCK.match(text)
    if not m:
        return None
    h, mi, s, frac, _, sign, oh, om = m.groups()
    ms = (int(h) * 60 + int(mi)) * 60_000 + int(s) * 1000 + (int(frac[:3].ljust(3, "0")) if frac else 0)
    return ms - (int(oh) * 60 + int(om)) * 60_000 * (-1 if sign == "-" else 1) if sign else ms


_DATES = [(re.compile(r"(\d{4})-(\d\d)-(\d\d)\Z"), (0, 1, 2)), (re.compile(r"(\d{4})/(\d\d)/(\d\d)\Z"), (0, 1, 2)), (re.compile(r"(\d\d)\.(\d\d)\.(\d{4})\Z"), (2, 1, 0))]


def stamp_ms(day: str, clock: str) -> int | None:
    """Epoch milliseconds of a date (year first, or day first with dots) and a time."""
    for pattern, (y, m, d) in _DATES:
        if hit := pattern.match(day):
            base, ms = day_ms(int(hit[y + 1]), int(hit[m + 1]), int(hit[d + 1])), clock_ms(clock)
            return None if base is None or ms is None else base + ms
    return None


def iso_ms(text: str) -> int | None:
    """Epoch milliseconds of an ISO time with T or a space."""
    return stamp_ms(text[:10], text[11:]) if len(text) > 18 and text[10] in "Tt " else None


def any_ms(text: str) -> int | None:
    """Epoch milliseconds of an ISO time, or of a count of seconds (with a fraction) or milliseconds since 1970."""
    if (ms := iso_ms(text)) is not None:
        return ms
    m = re.match(r"(\d{9,})(?:\.(\d+))?\Z", text)
    if not m:
        return None
    if len(m[1]) >= 12:  # thirteen digits are milliseconds, sixteen micro-, nineteen nanoseconds
        return int(m[1]) // 1000 ** ((len(m[1]) - 12) // 3)
    return int(m[1]) * 1000 + (int(m[2][:3].ljust(3, "0")) if m[2] else 0)


def yearless_ms(month: int, day: int, clock: str, not_after: int) -> int | None:
    """The latest time of that month, day and time of day that is not after not_after."""
    ms = clock_ms(clock)
    if ms is None:
        return None
    year = datetime.fromtimestamp(min(not_after, _LAST_MS) / 1000, UTC).year
    for y in range(year, max(0, year - 10), -1):
        base = day_ms(y, month, day)
        if base is not None and base + ms <= not_after:
            return base + ms
    return None


def without_place(name: str) -> str:
    """A component without line number: 'store/lease.go:281' is 'store/lease.go'."""
    return re.sub(r"(:\d+)+\Z", "", name)


#: time, level, component, and where the message begins and ends (bytes from the line's start; None: to its end).
Entry = tuple[int, str, str, int, int | None]


class _Line:
    """Tokens of a line: kinds k, texts by number."""

    __slots__ = ("raw", "at", "to", "k", "b", "e", "n")

    def __init__(self, raw: bytes, at: int, to: int, k: list, b: list, e: list):
        self.raw, self.at, self.to, self.k, self.b, self.e, self.n = raw, at, to, k, b, e, len(k)

    def text(self, i: int) -> str:
        return self.raw[self.b[i] : self.e[i]].decode("utf-8", "replace") if i < self.n else ""

    def kind(self, i: int) -> int:
        return self.k[i] if i < self.n else -1

    def span(self, i: int) -> tuple[str, int]:
        """From token i to the next gap, and the token after it."""
        j = i
        while j + 1 < self.n and self.b[j + 1] == self.e[j]:
            j += 1
        return self.raw[self.b[i] : self.e[j]].decode("utf-8", "replace"), j + 1

    def after(self, i: int) -> int:
        """Where token i begins, counted from the line's start."""
        return (self.b[i] if i < self.n else self.to) - self.at


_WORD, _NUMBER, _DATE, _TIME, _QUOTED, _COLON = (_S[x] for x in ("word", "number", "date", "time", "quoted", ":"))
_COMMA, _EQ, _PIPE, _LB, _RB, _LC, _RC, _LP, _RP, _LT, _GT = (_S[x] for x in _PUNCT)
_BOXES = {_LB: _RB, _LP: _RP, _LT: _GT}


def _syslog(t: _Line, ms: int) -> Entry | None:
    """<pri>version time host app pid id data message, or <pri>month day time host app[pid]: message."""
    if t.kind(1) != _NUMBER or t.kind(2) != _GT or not t.text(1).isdigit() or int(t.text(1)) > 191:
        return None
    level = _SEVERITY[int(t.text(1)) & 7]
    if t.kind(3) == _NUMBER and t.kind(4) == _TIME:
        if (ts := iso_ms(t.text(4))) is None:
            return None
        _, i = t.span(5)
        app, i = t.span(i) if i < t.n else ("", i)
        for _ in range(2):
            _, i = t.span(i) if i < t.n else ("", i)
        if t.kind(i) == _LB:  # structured data: quoted values may hold brackets
            while i < t.n and not (t.k[i] == _RB and t.kind(i + 1) != _LB):
                i += 1
            i += 1
        elif t.text(i) == "-":
            i += 1
        return ts, level, "" if app == "-" else app, t.after(i), None
    month = _MONTHS.get(t.text(3).lower())
    if month is None or t.kind(4) != _NUMBER or t.kind(5) != _TIME:
        return None
    if (ts := yearless_ms(month, int(t.text(4)), t.text(5), ms)) is None:
        return None
    _, i = t.span(6)
    app, j = t.span(i) if i < t.n else ("", i)
    return ts, level, re.sub(r"(\[\d*\])?:?\Z", "", app), t.after(j), None


def _json_text(t: _Line, i: int) -> str:
    if t.kind(i) != _QUOTED:
        return t.text(i)
    text = t.text(i)
    if "\\" in text:
        try:
            return json.loads(text)
        except ValueError:
            pass
    return text[1:-1]


def _fields(ts: int | None, get, spans: dict[str, tuple[int, int]]) -> Entry | None:
    """An entry from the keys of a structured line."""
    if ts is None:
        return None
    level = get(_LEVEL_KEYS) or ""
    if level.isdigit():
        n = int(level)
        level = _NUMBERED.get(n // 10 * 10, "FATAL" if n > 60 else "") if n >= 10 else _SEVERITY[n] if n < 8 else ""
    else:
        level = LEVEL_OF.get(level.lower(), "")
    component = get(_COMPONENT_KEYS) or without_place(get(_PLACE_KEYS) or "")
    where = next((spans[k] for k in _MESSAGE_KEYS if k in spans), (0, None))
    return ts, level, component, *where


def _json(t: _Line, ms: int) -> Entry | None:
    """One object on one line, with its keys in any order, or one level down."""
    top: dict[str, str] = {}
    deep: dict[str, str] = {}
    spans: dict[str, tuple[int, int]] = {}
    depth, i, closed = 0, 0, False
    while i < t.n:
        k = t.k[i]
        if k in (_LC, _LB):
            depth += 1
        elif k in (_RC, _RB):
            depth -= 1
            if not depth:
                closed = True
                break
        elif k == _QUOTED and t.kind(i + 1) == _COLON:
            key, i = _json_text(t, i), i + 2
            if t.kind(i) in (_LC, _LB):
                continue
            (top if depth == 1 else deep).setdefault(key, _json_text(t, i))
            if depth == 1 or key not in spans:
                spans[key] = (t.b[i] - t.at + (t.k[i] == _QUOTED), t.e[i] - t.at - (t.k[i] == _QUOTED)) if i < t.n else (0, None)
        i += 1
    if not closed:
        return None

    def get(keys: tuple[str, ...]) -> str | None:
        return next((d[x] for d in (top, deep) for x in keys if x in d), None)

    return _fields(any_ms(get(_TIME_KEYS) or ""), get, spans)


def _pairs(t: _Line, ms: int) -> Entry | None:
    """key=value key="quoted value" ..., in any order."""
    got: dict[str, str] = {}
    spans: dict[str, tuple[int, int]] = {}
    i = 0
    while i + 1 < t.n:
        if t.k[i] in (_WORD, _NUMBER) and t.k[i + 1] == _EQ and t.b[i + 1] == t.e[i]:
            key, j = t.text(i), i + 2
            if j < t.n and t.b[j] == t.e[i + 1]:
                if t.k[j] == _QUOTED:
                    value, i, span = _json_text(t, j), j + 1, (t.b[j] + 1 - t.at, t.e[j] - 1 - t.at)
                else:
                    value, i = t.span(j)
                    span = (t.b[j] - t.at, t.e[i - 1] - t.at)
            else:
                value, i, span = "", j, (t.e[i + 1] - t.at, t.e[i + 1] - t.at)
            got.setdefault(key, value)
            spans.setdefault(key, span)
        else:
            i += 1
    get = lambda keys: next((got[x] for x in keys if x in got), None)
    return _fields(any_ms(get(_TIME_KEYS) or ""), get, spans)


def _level_of(text: str) -> str | None:
    return LEVEL_OF.get(text.rstrip(":").lower())


def _iso_first(t: _Line, ms: int) -> Entry | None:
    """time LEVEL [component] message, or time LEVEL component: message."""
    ts = iso_ms(t.text(0))
    if ts is None:
        return None
    level = _level_of(t.text(1))
    if level is None or len(t.text(1)) < 3 or not (t.text(1).isupper() or t.kind(2) == _LB):
        return None
    if t.kind(2) == _LB:
        i = 3
        while i < t.n and t.k[i] != _RB:
            i += 1
        return (ts, level, t.raw[t.e[2] : t.b[i]].decode("utf-8", "replace"), t.after(i + 1), None) if i < t.n else None
    target, j = t.span(2) if t.n > 2 else ("", 2)
    if not target.endswith(":"):
        return None
    return ts, level, without_place(target[:-1]), t.after(j), None


def _date_first(t: _Line, ms: int) -> Entry | None:
    """date time - component - LEVEL - message; date time [thread] LEVEL component - message; date time | host | message <LVL> @component."""
    if t.kind(1) not in (_TIME,):
        return None
    ts = stamp_ms(t.text(0), t.text(1))
    if ts is None:
        return None
    if t.kind(2) == _PIPE:
        i = 3
        while i < t.n and t.k[i] != _PIPE:
            i += 1
        if i == t.n:
            return None
        for j in range(t.n - 4, i, -1):
            if t.k[j] == _LT and t.k[j + 2] == _GT and t.k[j + 3] == _WORD and t.text(j + 3)[0] == "@" and _level_of(t.text(j + 1)):
                return ts, _level_of(t.text(j + 1)), t.span(j + 3)[0][1:], t.after(i + 1), t.after(j)
        got = _general(t, ms)  # else the first field is a host
        return got if got[1] or got[2] else (ts, "", "", t.after(i + 1), None)
    if t.kind(2) == _LB:
        i = 3
        while i < t.n and t.k[i] != _RB:
            i += 1
        level = _level_of(t.text(i + 1))
        if level is None:
            return None
        name, j = t.span(i + 2) if i + 2 < t.n else ("", i + 2)
        return (ts, level, without_place(name), t.after(j + 1), None) if t.text(j) == "-" else None
    if t.text(2) == "-" and t.kind(3) not in _BOXES:
        name, j = t.span(3) if t.n > 3 else ("", 3)
        if t.text(j) == "-" and (level := _level_of(t.text(j + 1))) is not None:
            return ts, level, without_place(name), t.after(j + 2 + (t.text(j + 2) == "-")), None
        return None
    return None


def _bracket(t: _Line, ms: int) -> Entry | None:
    """[date time] (component) level: message."""
    if t.kind(2) != _TIME or t.kind(3) != _RB:
        return None
    ts = stamp_ms(t.text(1), t.text(2))
    if ts is None:
        return None
    i, name = 4, ""
    if t.kind(4) == _LP:
        while i < t.n and t.k[i] != _RP:
            i += 1
        name = t.raw[t.e[4] : t.b[i]].decode("utf-8", "replace") if i < t.n else ""
        i += 1
    level = _level_of(t.text(i))
    return None if level is None or not name else (ts, level, name, t.after(i + 1), None)


def _seconds_first(t: _Line, ms: int) -> Entry | None:
    """seconds.fraction L component| message."""
    text = t.text(0)
    if not re.match(r"\d{9,10}\.\d+\Z", text) or (level := _level_of(t.text(1))) is None:
        return None
    i = 2
    while i < t.n and t.k[i] != _PIPE:
        i += 1
    if i == t.n:
        return None
    return any_ms(text), level, t.raw[t.b[2] : t.b[i]].decode("utf-8", "replace").strip(), t.after(i + 1), None


def _letter_first(t: _Line, ms: int) -> Entry | None:
    """Lmmdd time thread file:line] message."""
    m = re.match(r"([A-Z])(\d\d)(\d\d)\Z", t.text(0))
    if not m or t.kind(1) != _TIME or t.kind(2) != _NUMBER or t.kind(4) != _RB or (level := _level_of(m[1])) is None:
        return None
    ts = yearless_ms(int(m[2]), int(m[3]), t.text(1), ms)
    return None if ts is None else (ts, level, without_place(t.text(3)), t.after(5), None)


_ACCESS = re.compile(r"(\d\d)/([A-Za-z]{3})/(\d{4}):(.*)\Z")


def _access(t: _Line, ms: int) -> Entry | None:
    """host ident user [day/Mon/year:time zone] "request" status bytes: it states neither level nor component."""
    i = 1
    while i < min(t.n, 8) and t.k[i] != _LB:
        i += 1
    m = _ACCESS.match(t.text(i + 1)) if t.kind(i) == _LB else None
    if not m or i < 3 or m[2].lower() not in _MONTHS:
        return None
    zone = t.text(i + 2) if t.kind(i + 2) != _RB else ""
    base, clock = day_ms(int(m[3]), _MONTHS[m[2].lower()], int(m[1])), clock_ms(m[4] + zone)
    return None if base is None or clock is None else (base + clock, "", "", t.after(i + 3 + bool(zone)), None)


def _time_at(t: _Line, i: int, ms: int) -> tuple[int, int] | None:
    """A time that begins at token i, and the token after it: ISO, day and time, or month, day and time (the year may come last)."""
    if t.kind(i) == _TIME and (ts := iso_ms(t.text(i))) is not None:
        return ts, i + 1
    if t.kind(i) == _DATE and t.kind(i + 1) == _TIME:
        zone = t.text(i + 2) if re.match(r"(?:Z|[+-]\d\d:?\d\d)\Z", t.text(i + 2)) and "." not in t.text(i + 2) else ""
        if (ts := stamp_ms(t.text(i), t.text(i + 1) + zone)) is not None:
            return ts, i + 2 + bool(zone)
    month = _MONTHS.get(t.text(i).lower())
    if month and t.kind(i + 1) == _NUMBER and t.kind(i + 2) == _TIME:
        if re.match(r"\d{4}\Z", t.text(i + 3)):
            base, clock = day_ms(int(t.text(i + 3)), month, int(t.text(i + 1))), clock_ms(t.text(i + 2))
            return None if base is None or clock is None else (base + clock, i + 4)
        if (ts := yearless_ms(month, int(t.text(i + 1)), t.text(i + 2), ms)) is not None:
            return ts, i + 3
    return None


def _boxed(t: _Line, i: int) -> tuple[str, int] | None:
    """What stands in brackets that open at token i, and the token after them."""
    if t.kind(i) not in _BOXES:
        return None
    j = i + 1
    while j < t.n and t.k[j] != _BOXES[t.k[i]]:
        j += 1
    return (t.raw[t.e[i] : t.b[j]].decode("utf-8", "replace").strip(), j + 1) if j < t.n else None


def _stated_level(t: _Line, i: int) -> tuple[str, int] | None:
    """A level at token i, and the token after it: in brackets, in capitals (three letters or more), or before a colon."""
    if box := _boxed(t, i):
        return (level, box[1]) if (level := LEVEL_OF.get(box[0].lower())) else None
    text = t.text(i)
    level = LEVEL_OF.get(text.lower()) if t.kind(i) == _WORD else None
    colon = t.kind(i + 1) == _COLON and t.b[i + 1] == t.e[i]
    if level and (colon or (len(text) > 2 and text.isupper())):
        return level, i + 1 + colon
    if t.kind(i) == _TIME and text.endswith(":") and (level := LEVEL_OF.get(text[:-1].lower())):  # a word and its colon are one token
        return level, i + 1
    if t.kind(i) == _WORD and text.endswith(":") and (level := LEVEL_OF.get(text[:-1].lower())):
        return level, i + 1
    return None


def _general(t: _Line, ms: int) -> Entry | None:
    """A layout that isn't known: perhaps a level, a time (bare or in brackets), and then level and component in any order, as far as
    they are marked as such: a level as in _stated_level, a component by brackets or by a colon after it (perhaps with a host before)."""
    level = None
    i = 0
    if got := _stated_level(t, i):
        level, i = got
    box = t.kind(i) in _BOXES
    got = _time_at(t, i + box, ms)
    if got is None:
        return None
    by_month = t.kind(i + box) == _WORD
    ts, i = got
    if box:
        if t.kind(i) not in _BOXES.values():
            return None
        i += 1
    name = None
    for _ in range(6):
        if t.text(i) in ("-", "|", ",") or t.kind(i) == _COLON:
            i += 1
        elif level is None and (got := _stated_level(t, i)):
            level, i = got
        elif name is None and (got := _boxed(t, i)) and re.match(r"[\w.:/$-]+\Z", got[0]) and not got[0].isdigit():
            name, i = without_place(got[0]), got[1]
        else:
            break
    if name is None and i < t.n:
        text, j = t.span(i)
        if not text.endswith(":") and by_month and j < t.n:  # the host comes first
            text, j = t.span(j)
        elif not text.endswith(":") and j < t.n and re.match(r"[\w./-]+\[\d+\]:\Z", t.span(j)[0]):
            text, j = t.span(j)
        if re.match(r"[A-Za-z_][\w.:/$-]*(\[\d+\])?:\Z", text):
            name, i = without_place(re.sub(r"(\[\d+\])?:\Z", "", text)), j
            if level is None and (got := _stated_level(t, i)):
                level, i = got
    return ts, level or "", name or "", t.after(i), None


def grammar(t: _Line, ms: int) -> Entry | None:
    """The entry that a line starts, by the first grammar its first tokens allow; None for a continuation."""
    if not t.n or t.b[0] != t.at:  # it begins with white space
        return None
    first, second = t.k[0], t.kind(1)
    if first == _LT:
        return _syslog(t, ms) or _general(t, ms)
    if first == _LC:
        return _json(t, ms) if second == _QUOTED else None
    if first == _LB:
        return _bracket(t, ms) or _general(t, ms)
    if second == _EQ:
        return _pairs(t, ms)
    if first == _TIME:
        return _iso_first(t, ms) or _access(t, ms) or _general(t, ms)
    if first == _DATE:
        return _date_first(t, ms) or _seconds_first(t, ms) or _access(t, ms) or _general(t, ms)
    if first == _WORD:
        return _letter_first(t, ms) or _access(t, ms) or _general(t, ms)
    return None


def parse_lines(lines: pa.Array, ms: pa.Array) -> pa.StructArray:
    """ts_ms, log_level, component and message of each line that starts an entry, null for the others (and for null lines)."""
    lines = lines.fill_null("")
    n = len(lines)
    buffers = lines.buffers()
    kind = np.int64 if pa.types.is_large_string(lines.type) else np.int32
    offsets = np.frombuffer(buffers[1], kind, n + 1, lines.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = buffers[2].to_pybytes() if n and buffers[2] is not None else b""
    data = np.frombuffer(raw, np.uint8)
    when = ms.fill_null(0).to_pylist()
    begin = offsets[:-1].tolist()
    end = offsets[1:].tolist()
    out: list[dict | None] = [None] * n
    for rows, first, kinds, b, e in tokenise(data, offsets[:-1], np.diff(offsets)):
        ask = may_begin(first, kinds)
        some = np.flatnonzero(ask)
        ask[some] = b[first[some]] == offsets[rows[some]]  # white space before the first token: a continuation
        lines_, lows, highs = rows[ask].tolist(), first[:-1][ask].tolist(), first[1:][ask].tolist()
        kinds, b, e = kinds.tolist(), b.tolist(), e.tolist()
        for r, lo, hi in zip(lines_, lows, highs):
            got = grammar(_Line(raw, begin[r], end[r], kinds[lo:hi], b[lo:hi], e[lo:hi]), when[r])
            if got is not None:
                ts, level, component, at, to = got
                message = raw[begin[r] + at : end[r] if to is None else begin[r] + to].decode("utf-8", "replace").strip()
                out[r] = {"ts_ms": ts, "log_level": level, "component": component, "message": message}
    return pa.array(out, pa.struct([("ts_ms", pa.int64()), ("log_level", pa.string()), ("component", pa.string()), ("message", pa.string())]))


def parsed(lines: DataFrame, line: str = "body", ms: str = "ulid_ms") -> DataFrame:
    """lines with a struct `entry` (ts_ms, log_level, component, message), null where a line starts no entry."""

    @F.arrow_udf("ts_ms bigint, log_level string, component string, message string")
    def fields(text: pa.Array, when: pa.Array) -> pa.Array:
        return parse_lines(text, when)

    # else Spark calls it once for each field that is used
    return lines.withColumn("entry", fields.asNondeterministic()(F.col(line), F.col(ms)))


def entries(lines: DataFrame, stream: tuple[str, ...], order: str, ms: str, shard_ms: int = SHARD_MS, text: str | None = None) -> DataFrame:
    """One row per entry: the stream's columns, `order` of its first line, the fields of `entry`, and n_lines.

    lines: output of parsed(). Lines of a stream go in `order`, which is unique in it; a line that starts no entry belongs to the entry before
    it, and to none where there is none (it is left out). Nulls in the stream's columns make a stream of their own; rows with a null order are
    left out. text: the column of the lines' texts, if the entry's field `message` is to go on with those of its continuations, one a line
    (one value, so an entry has room for 2 GB). A stream of any size is spread over shards of shard_ms; what is ordered in one piece is
    one row a shard.
    """
    keys = [f"_k{n}" for n in range(len(stream))]
    d = lines.where(F.col(order).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(stream, keys)], F.expr(f"{ms} div {shard_ms}").alias("_shard"), F.col(order).alias("_at"), "entry", *([F.col(text).alias("_text")] if text else []))
    starts = F.col("entry").isNotNull()
    shard = Window.partitionBy(*keys, "_shard")
    w = shard.orderBy("_at")
    if text:
        d = d.withColumn("_of", F.max(F.when(starts, F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        more = F.sort_array(F.collect_list(F.when(~starts, F.struct("_at", F.coalesce("_text", F.lit("")).alias("t")))))
        d = d.groupBy(*keys, "_shard", "_of").agg(F.max("entry").alias("entry"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(more, lambda x: x["t"]), "\n").alias("_text"))
        d = d.withColumnRenamed("_of", "_at").withColumn("_last", F.col("_at").isNotNull() & (F.lead("_at").over(w).isNull()))
    else:
        # kept are first lines of entries and of shards; a line counts for what is kept before it
        d = d.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(shard)).where(starts | (F.col("_n") == 1))
        then = F.lead("_n").over(w)
        d = d.withColumn("_last", starts & then.isNull()).withColumn("n", F.coalesce(then, F.col("_all") + 1) - F.col("_n")).withColumn("_at", F.when(starts, F.col("_at"))).drop("_n", "_all")
    # _at null: the lines before a shard's first entry
    own = written(d, "entries")  # it is read more than once below, and all that is before it must run once
    ends = own.where("_last or _at is null").select(*keys, "_shard", "_at", "n", *(["_text"] if text else []))
    each = ends.groupBy(*keys, "_shard").agg(F.max(F.when(F.col("_at").isNotNull(), F.struct("_shard", "_at"))).alias("_end"), F.coalesce(F.sum(F.when(F.col("_at").isNull(), F.col("n"))), F.lit(0)).alias("_lead"), *([F.max(F.when(F.col("_at").isNull(), F.col("_text"))).alias("_text")] if text else []))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_to", F.max("_end").over(before)).where("_lead > 0 and _to is not null")
    # they belong to the last entry of an earlier shard: one row a shard
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_shard", "_text"))), lambda x: x["_text"]), "\n")
    carried = carried.groupBy(*keys, F.col("_to._shard").alias("_shard")).agg(F.sum("_lead").alias("_more"), *([parts.alias("_tail")] if text else []))
    last = own.where("_last").alias("o")
    same = F.col("o._shard") == F.col("c._shard")
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}"))
    last = last.join(carried.alias("c"), same, "left").select("o.*", "_more", *(["_tail"] if text else []))
    rest = own.where("_at is not null and not _last").withColumn("_more", F.lit(None).cast("bigint"))
    if text:
        rest = rest.withColumn("_tail", F.lit(None).cast("string"))
    out = rest.unionByName(last)
    if text:
        lead = F.when(F.col("n") > 1, F.concat(F.lit("\n"), F.col("_text"))).otherwise("")
        carried_text = F.when(F.col("_more") > 0, F.concat(F.lit("\n"), F.col("_tail"))).otherwise("")
        out = out.withColumn("entry", F.col("entry").withField("message", F.concat(F.col("entry.message"), lead, carried_text)))
    return out.select(*[F.col(k).alias(c) for c, k in zip(stream, keys)], F.col("_at").alias(order), "entry.*", (F.col("n") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("n_lines"))

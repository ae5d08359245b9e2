"""Regular expressions of the linear-time dialect (RE2) in Java's dialect, or an error where they are not of it.

The two differ in the newline before the end, in ASCII and Unicode classes, in flags and in what Java adds (look-around,
back-references, possessive quantifiers, nested classes); all of that is rewritten or refused here.
"""

from __future__ import annotations

import re

# Named classes and their Java names.
_POSIX = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}", "graph": "\\p{Graph}",
    "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\p{Space}", "upper": "\\p{Upper}", "word": "\\w", "xdigit": "\\p{XDigit}",
}
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_BLANK = r"\t\n\f\r "


class BadRegex(ValueError):
    """Not an expression of this dialect."""


def translate(pattern: str) -> str:
    """The Java pattern that finds what `pattern` finds; BadRegex if it is none of the dialect."""
    return "(?d)" + _Translator(pattern).run()


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.at, self.out, self.names = pattern, 0, [], {}
        self.flags = [{"m": False, "U": False}]

    def run(self) -> str:
        while self.at < len(self.p):
            self.step()
        if len(self.flags) > 1:
            raise BadRegex("missing closing )")
        return "".join(self.out)

    def take(self, n: int = 1) -> str:
        text = self.p[self.at : self.at + n]
        self.at += n
        return text

    def step(self) -> None:
        ch = self.p[self.at]
        if ch == "\\":
            self.out.append(self.escape(False))
        elif ch == "[":
            self.out.append(self.character_class())
        elif ch == "(":
            self.group()
        elif ch == ")":
            if len(self.flags) == 1:
                raise BadRegex("unexpected )")
            self.flags.pop()
            self.out.append(self.take())
        elif ch in "*+?" or ch == "{":
            self.quantifier()
        elif ch == "$":
            self.take()
            self.out.append("$" if self.flags[-1]["m"] else "\\z")
        elif ch in "}]":
            self.out.append("\\" + self.take())
        else:
            self.out.append(self.take())

    def quantifier(self) -> None:
        m = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}").match(self.p, self.at)
        if not m:
            self.take()
            self.out.append("\\{")
            return
        if not self.out or self.out[-1] in ("(", "(?:", "|"):
            raise BadRegex(f"nothing to repeat before {m[0]}")
        if m[0][0] == "{" and max(int(x) for x in re.findall(r"\d+", m[0])) > 1000:
            raise BadRegex("repeated more than 1000 times")
        self.at = m.end()
        lazy = self.p.startswith("?", self.at)
        self.at += lazy
        if self.at < len(self.p) and (self.p[self.at] in "*+?" or re.compile(r"\{\d+(?:,\d*)?\}").match(self.p, self.at)):
            raise BadRegex("quantifier after quantifier")
        self.out.append(m[0] + ("?" if lazy != self.flags[-1]["U"] else ""))

    def group(self) -> None:
        p = self.p
        if not p.startswith("(?", self.at):
            self.out.append(self.take())
            self.flags.append(dict(self.flags[-1]))
            return
        if m := re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(p, self.at):
            if m[1] in self.names:
                raise BadRegex(f"two groups named {m[1]}")
            self.names[m[1]] = f"g{len(self.names)}{re.sub('[^A-Za-z0-9]', '', m[1])}"
            self.at = m.end()
            self.out.append(f"(?<{self.names[m[1]]}>")
            self.flags.append(dict(self.flags[-1]))
            return
        m = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(p, self.at)
        if not m or not (m[1] or m[2] or m[3] == ":"):
            raise BadRegex(f"no such group: {p[self.at : self.at + 4]}")
        self.at = m.end()
        now = dict(self.flags[-1])
        now |= {f: True for f in m[1] if f in now} | {f: False for f in m[2] or "" if f in now}
        on, off = (x.replace("i", "iu").replace("U", "") for x in (m[1], m[2] or ""))
        self.out.append(f"(?{on}{'-' + off if off else ''}{m[3]}" if on or off or m[3] == ":" else "")
        if m[3] == ":":
            self.flags.append(now)
        else:
            self.flags[-1] = now

    def escape(self, inside: bool) -> str:
        self.take()
        if self.at == len(self.p):
            raise BadRegex("trailing backslash")
        ch = self.take()
        if ch == "Q":
            end = self.p.find("\\E", self.at)
            text = self.p[self.at : end if end >= 0 else len(self.p)]
            self.at = end + 2 if end >= 0 else len(self.p)
            return re.sub(r"([^\w\s])", r"\\\1", text)
        if ch in "sS":
            return (_BLANK if inside else f"[{_BLANK}]") if ch == "s" else f"[^{_BLANK}]"
        if ch in "dDwWafnrtv" or ch in "xpP":
            if ch == "v":
                return "\\x0B"
            if ch in "pP":
                m = re.compile(r"\{(\^?)(\w+)\}|([A-Z])").match(self.p, self.at)
                if not m:
                    raise BadRegex("no such class")
                self.at = m.end()
                name, negated = m[2] or m[3], (ch == "P") != bool(m[1])
                return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
            if ch == "x":
                m = re.compile(r"\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}").match(self.p, self.at)
                if not m:
                    raise BadRegex("no such character")
                self.at = m.end()
                return "\\x" + m[0]
            return "\\" + ch
        if not inside and ch in "bBAz":
            return {"b": _EDGE, "B": _NO_EDGE}.get(ch, "\\" + ch)
        if ch == "0":
            m = re.compile(r"[0-7]{1,2}").match(self.p, self.at)
            self.at = m.end() if m else self.at
            return "\\0" + (m[0] if m else "0")
        if ch.isalnum():
            raise BadRegex(f"no such escape: \\{ch}")
        return "\\" + ch

    def character_class(self) -> str:
        out = [self.take()]
        if self.p.startswith("^", self.at):
            out.append(self.take())
        first = True
        while True:
            if self.at >= len(self.p):
                raise BadRegex("missing closing ]")
            ch = self.p[self.at]
            if ch == "]" and not first:
                out.append(self.take())
                return "".join(out)
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.at):
                if m[2] not in _POSIX:
                    raise BadRegex(f"no such class: {m[2]}")
                self.at = m.end()
                name = _POSIX[m[2]]
                out.append(f"\\{name[1].upper()}{name[2:]}" if m[1] else name)
            elif ch == "\\":
                out.append(self.escape(True))
            elif ch in "[]&":
                out.append("\\" + self.take())
            else:
                out.append(self.take())


def check_by_engine(spark, pattern: str) -> str:
    """translate(), and the result compiled by the engine that will run it."""
    java = translate(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise BadRegex(pattern) from e
    return java

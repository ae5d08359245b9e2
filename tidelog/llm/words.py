"""Words of a text, without what printing adds: case, punctuation, soft hyphens, zero-width characters, hyphens at line ends."""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    """Lower-case words in order; none for null and empty texts."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


def words_with_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words, and where in the text each begins and ends (with what is invisible or broken inside it)."""
    at = list(range(len(text)))
    for gone in (_INVISIBLE, _BROKEN):
        if cut := {k for m in gone.finditer(text) for k in range(*m.span())}:
            left = [k for k in range(len(text)) if k not in cut]
            text, at = "".join([text[k] for k in left]), [at[k] for k in left]
    low = text.lower()
    if len(low) != len(text):  # a few letters are two in lower case
        at = [a for a, c in zip(at, text) for _ in c.lower()]
    hits = list(_WORD.finditer(low))
    return [m[0] for m in hits], [(at[m.start()], at[m.end() - 1] + 1) for m in hits]


def runs(texts: list[str], characters: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of so many characters together (or one text alone), so that what is made of them at once has a bounded size."""
    out, at, size = [], 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > characters:
            out.append((at, k))
            at, size = k, 0
        size += len(t)
    return [*out, (at, len(texts))] if texts else out

"""Where a spot of a comparison stands: in a field's raw text, TeX and all.

The comparison's key drops, folds and rewrites characters. Here the same
rewriting runs over a text whose characters remember the raw range they come
from, so a place in the key is a raw range without searching: a symbol stands
for its whole command, a composed character for all it was composed of.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column

from . import text as readings
from .markup import without_tables


class Tracked(NamedTuple):
    """A text and the raw range behind each of its characters."""

    text: str
    start: list[int]
    end: list[int]

    def rewritten(self, pattern: re.Pattern, parts: Callable[[re.Match], list]) -> Tracked:
        """Each match replaced by ``parts``: strings, which stand for the whole match, and ranges, which keep their own places."""
        out: list[str] = []
        start: list[int] = []
        end: list[int] = []

        def keep(a: int, b: int) -> None:
            out.append(self.text[a:b])
            start.extend(self.start[a:b])
            end.extend(self.end[a:b])

        at = 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            keep(at, a)
            for part in parts(m):
                if isinstance(part, str):
                    out.append(part)
                    start.extend([min(self.start[a:b])] * len(part))
                    end.extend([max(self.end[a:b])] * len(part))
                else:
                    keep(*part)
            at = b
        keep(at, len(self.text))
        return Tracked("".join(out), start, end)


_SPACE = re.compile(r"\s+")
# Characters that may compose with the one before: marks, Hangul vowels and finals, halfwidth voicing marks.
_JOINS = re.compile(r"[ᅠ-ᇿힰ-퟿ﾞﾟﾠ-ￜ]")


def _folded(t: Tracked) -> Tracked:
    """Compatibility folding, cluster by cluster."""
    if unicodedata.is_normalized("NFKC", t.text):
        return t
    joins = lambda c: unicodedata.category(c)[0] == "M" or _JOINS.match(c)
    bounds = [i for i, c in enumerate(t.text) if not i or not joins(c)]
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    for a, b in zip(bounds, [*bounds[1:], len(t.text)]):
        piece = unicodedata.normalize("NFKC", t.text[a:b])
        out.append(piece)
        start.extend([min(t.start[a:b])] * len(piece))
        end.extend([max(t.end[a:b])] * len(piece))
    return Tracked("".join(out), start, end)


def aligned_key(raw: str | None) -> Tracked:
    """:func:`.text.witness_key` of a text, each character with its raw range."""
    raw = raw or ""
    t = Tracked(raw, list(range(len(raw))), list(range(1, len(raw) + 1)))
    for pattern, parts in readings.KEY_BEFORE:
        t = t.rewritten(pattern, parts)
    t = _folded(t.rewritten(readings._RAISED, lambda m: [readings._EXPONENTS[ord(m[0])]]))
    t = t.rewritten(readings._TOKEN, lambda m: [readings._printed(m)])
    t = t.rewritten(readings._FOLDED, lambda m: [readings._FOLD[m[0]]]).rewritten(_SPACE, lambda m: [])
    for old, new in (("//", "∥"), ("^°", "°"), ("[]", "()")):
        t = t.rewritten(re.compile(re.escape(old)), lambda m: [new])  # noqa: B023
    for pattern, parts in readings.KEY_AFTER:
        t = t.rewritten(pattern, parts)
    return t


def _evidence(key: str) -> str:
    return readings._NO_EVIDENCE.sub("", key)


def _found(key: str, spot: dict) -> int | None:
    """Where a spot's reading begins in a key: between its surroundings, the nearest to its place; or at its place, surroundings without marks."""
    before, reading, after, at = spot.get("before") or "", spot.get("reading") or "", spot.get("after") or "", spot.get("at")
    if not reading:
        return None
    hits = [m.start() + len(before) for m in re.finditer(f"(?={re.escape(before + reading + after)})", key)]
    if hits:
        return min(hits, key=lambda h: abs(h - at)) if at is not None else hits[0]
    if at is not None and key.startswith(reading, at) and _evidence(key[:at]).endswith(before) and _evidence(key[at + len(reading) :]).startswith(after):
        return at
    return None


def raw_range(value: str | None, spot: dict) -> tuple[int, int] | None:
    """The raw range of a spot's reading in a text, None if the spot is not in it."""
    key = aligned_key(value)
    at = _found(key.text, spot)
    if at is None:
        return None
    to = at + len(spot["reading"])
    return min(key.start[at:to]), max(key.end[at:to])


def field_place(stem: str | None, options: dict | None, spot: dict) -> dict | None:
    """``{field, start, end}`` of a spot in a card: the stem (field ``stem``) or an option (its letter).

    Spots come from stem and options read as one text, so they are looked up in
    that text and mapped back; a range across two fields has no place. A stem
    with a table is compared without it, so it is searched by itself, after the
    options and without the spot's place.
    """
    stem, options = stem or "", {k: v for k, v in (options or {}).items() if str(v or "").strip()}
    table = without_tables(stem) != stem
    whole, fields = "" if table else stem, [] if table else [("stem", 0, len(stem))]
    for letter in sorted(options):
        whole += f"{letter}."
        fields.append((letter, len(whole), len(whole) + len(options[letter])))
        whole += options[letter]
    found = raw_range(whole, spot | {"at": None} if table else spot)
    if found:
        inside = [(name, a) for name, a, b in fields if a <= found[0] and found[1] <= b]
        if inside:
            name, a = inside[0]
            return {"field": name, "start": found[0] - a, "end": found[1] - a}
    if table and (found := raw_range(stem, spot | {"at": None})):
        return {"field": "stem", "start": found[0], "end": found[1]}
    return None


_PLACE = pa.struct([("field", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def place_column(stem: Column, options: Column, spot: Column) -> Column:
    """:func:`field_place` over columns; null options and null spots are none."""
    place = lambda s, o, p: field_place(s, dict(o) if o else None, p) if p else None
    return readings._column(place, "struct<field:string,start:int,end:int>", _PLACE, stem, options, spot)

"""Sanitising with offsets: one coordinate system from here on.

Invisible characters go, every other is folded by NFKC on its own, and offsets
into the old text are carried over.  What was removed, and spans that address a
model instead of a reader, are reported for quarantine; the text keeps the latter.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from quern.functions import text as patterns

ZERO_WIDTH = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD}
BIDI = {0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}

_FOUND = (
    ("instruction_addressed_to_model", re.compile(patterns.INSTRUCTION)),
    ("fake_role_marker", re.compile(patterns.ROLE_MARKER)),
    ("fake_delimiter", re.compile(patterns.DELIMITER)),
    ("exfiltration_request", re.compile(patterns.EXFILTRATION)),
)


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    reason: str
    text: str


@dataclass
class Clean:
    text: str
    headings: list[tuple[int, int, str]] = field(default_factory=list)
    page_offsets: list[int] = field(default_factory=list)
    quarantine: list[Span] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def invisible(c: str) -> bool:
    o = ord(c)
    if c in "\t\n\r":
        return False
    return o in ZERO_WIDTH or o in BIDI or 0xE0000 <= o <= 0xE007F or unicodedata.category(c) in ("Cc", "Cf")


@cache
def _special() -> re.Pattern:
    """Characters that go or change: no other takes any work."""
    points = [o for o in range(sys.maxunicode + 1) if invisible(c := chr(o)) or unicodedata.decomposition(c) and unicodedata.normalize("NFKC", c) != c]
    runs: list[list[int]] = []
    for o in points:
        if runs and o == runs[-1][1] + 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


#: What has only these needs no look at the large class.
_PLAIN = re.compile(r"[\t\n\r -~]*\Z")


def merge_spans(spans: list[Span], text: str) -> list[Span]:
    """Overlapping or touching spans of one reason become one."""
    out: list[Span] = []
    for reason in sorted({s.reason for s in spans}):
        run: list[Span] = []
        for s in sorted((s for s in spans if s.reason == reason), key=lambda s: (s.start, s.end)):
            if run and s.start <= run[-1].end and not (s.start == s.end == run[-1].end and s.start == run[-1].start):
                last = run.pop()
                end = max(last.end, s.end)
                run.append(Span(last.start, end, reason, text[last.start : end]))
            elif run and s.start == s.end == run[-1].start == run[-1].end:
                last = run.pop()
                run.append(Span(s.start, s.end, reason, last.text + s.text))
            else:
                run.append(s)
        out += run
    return sorted(out, key=lambda s: (s.start, s.end, s.reason))


def sanitise(raw: str, headings: list[tuple[int, int, str]] = (), page_offsets: list[int] = (), warnings: list[str] = ()) -> Clean:
    """``headings`` are (start, level, text); ``warnings`` of the form
    hidden:<offset>:<text> become quarantined points."""
    kept, removed = raw, []
    places, grown = [], [0]  # where a character went or changed, and how far later ones have moved
    if not _PLAIN.match(raw):
        parts, done, run = [], 0, -2
        for m in _special().finditer(raw):
            i, c = m.start(), m.group()
            hidden = invisible(c)
            new = "" if hidden else "".join(x for x in unicodedata.normalize("NFKC", c) if not invisible(x))
            if hidden and run == i - 1:
                removed[-1] = (removed[-1][0], removed[-1][1] + c)
            elif hidden:
                removed.append((i + grown[-1], c))
            run = i if hidden else -2
            parts += [raw[done:i], new]
            done = i + 1
            places.append(i)
            grown.append(grown[-1] + len(new) - 1)
        kept = "".join([*parts, raw[done:]])

    def move(o: int) -> int:
        o = min(max(o, 0), len(raw))
        return o + grown[bisect_left(places, o)]

    spans = [Span(at, at, "invisible_character", gone) for at, gone in removed]
    left = []
    for w in warnings:
        kind, _, rest = w.partition(":")
        at, _, hidden = rest.partition(":")
        if kind == "hidden" and at.isdigit():
            o = move(int(at))
            spans.append(Span(o, o, "hidden_text", hidden))
        else:
            left.append(w)
    for reason, pattern in _FOUND:
        spans += [Span(m.start(), m.end(), reason, m.group()) for m in pattern.finditer(kept) if m.group().strip()]
    return Clean(kept, [(move(a), level, t) for a, level, t in headings], [move(o) for o in page_offsets], merge_spans(spans, kept), left)


def prompt_safe(text: str, spans: list[Span]) -> str:
    """The text with quarantined spans blank: same length."""
    for s in spans:
        text = text[: s.start] + " " * (s.end - s.start) + text[s.end :]
    return text


SCHEMA = "text string, quarantine array<struct<start:int,end:int,reason:string,text:string>>"


def sanitise_column(df: DataFrame, id_: str, column: str) -> DataFrame:
    """(id, text, quarantine) of each row, in Arrow batches."""
    kind = df.schema[id_].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [sanitise(t or "") for t in part[column]]
            yield pd.DataFrame({id_: part[id_], "text": [c.text for c in done], "quarantine": [[{"start": s.start, "end": s.end, "reason": s.reason, "text": s.text} for s in c.quarantine] for c in done]})

    return df.select(id_, column).mapInPandas(run, f"{id_} {kind}, {SCHEMA}")

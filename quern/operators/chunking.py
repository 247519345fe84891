"""Structure-first chunking; a chunk's text is always a slice of its version.

Sections follow headings; a section that fits is one chunk, a longer one is cut
into paragraphs, or into sentences if it has but one, and these are packed
greedily.  A unit that is too long itself is cut at blanks.  Chunks of a cut
section begin a little before their predecessor's end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.errors import ConfigError

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+(?=[\"'“‘(\[A-ZÀ-ÖØ-Þ])|(?<=[.!?])\n+")


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 512
    overlap: int = 64
    structure_first: bool = True

    def __post_init__(self) -> None:
        if not 64 <= self.max_tokens <= 8192 or not 0 <= self.overlap < self.max_tokens:
            raise ConfigError("max_tokens must be 64 to 8192 and overlap below it")


@dataclass(frozen=True)
class Chunk:
    ordinal: int
    start: int
    end: int
    text: str
    heading_path: list[str]
    page_from: int | None
    page_to: int | None
    token_count: int


def count_tokens(text: str) -> int:
    return max(len(text.split()), int(len(text) / 4 + 0.5)) if text else 0


def _over(size: int, words: int, limit: int) -> bool:
    return max(words, int(size / 4 + 0.5)) > limit


def _too_long(text: str, start: int, end: int, limit: int) -> bool:
    """count_tokens(text[start:end]) > limit; words are counted only if it depends on them."""
    size = end - start
    return _over(size, 0, limit) or size + 1 > 2 * limit and len(text[start:end].split()) > limit


def sections(size: int, headings: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """(start, end, path): they tile the text."""
    marks = sorted(headings, key=lambda h: h[0])
    out, stack = [], []
    first = marks[0][0] if marks else size
    if first > 0:
        out.append((0, first, []))
    for i, (at, level, title) in enumerate(marks):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        end = marks[i + 1][0] if i + 1 < len(marks) else size
        if end > at:
            out.append((at, end, [t for _, t in stack]))
    return out


def _units(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans that tile the section: paragraphs, or sentences of a lone one."""
    for pattern in (_PARAGRAPH, _SENTENCE):
        cuts = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
        if cuts:
            edges = [start, *cuts, end]
            return list(zip(edges, edges[1:]))
    return [(start, end)]


def _hard(text: str, start: int, end: int, limit: int) -> Iterator[tuple[int, int]]:
    width = limit * 4
    while start < end:
        to = min(end, start + width)
        if to < end:
            blank = text.rfind(" ", start + width // 2, to)
            if blank > 0:
                to = blank + 1
        # dense text of short words may still be too long
        while count_tokens(text[start:to]) > limit and to - start > 1:
            to = start + max(1, (to - start) // 2)
        yield start, to
        start = to


def _packed(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    a = b = start
    words = 0  # of text[a:b]: units end with white space, so their words add up
    for u, v in _units(text, start, end):
        own = len(text[u:v].split())
        if b > a and _over(v - a, words + own, limit):
            out.append((a, b))
            a, words = b, 0
        if _over(v - u, own, limit):
            if b > a:
                out.append((a, b))
            cut = list(_hard(text, u, v, limit))
            out += cut[:-1]
            a, b = cut[-1]
            words = len(text[a:b].split())
        else:
            b = v
            words += own
    if b > a:
        out.append((a, b))
    return out


def chunk_text(text: str, headings: list[tuple[int, int, str]] = (), page_offsets: list[int] = (), limits: Limits = Limits()) -> list[Chunk]:
    found = []
    whole = sections(len(text), list(headings) if limits.structure_first else [])
    for start, end, path in whole:
        if not _too_long(text, start, end, limits.max_tokens):
            spans = [(start, end)]
        else:
            spans = _packed(text, start, end, limits.max_tokens)
            if limits.overlap and len(spans) > 1:
                moved = [spans[0]]
                for a, b in spans[1:]:
                    low = max(start, a - limits.overlap * 4)
                    blank = text.find(" ", low, a) if low > start else low - 1
                    moved.append((blank + 1 if blank >= low - 1 and blank + 1 < a else low, b))
                spans = moved
        for a, b in spans:
            piece = text[a:b]
            a2 = a + len(piece) - len(piece.lstrip())
            b2 = b - (len(piece) - len(piece.rstrip()))
            if b2 > a2:
                found.append((a2, b2, path))
    page = lambda o: max(1, bisect_right(page_offsets, o)) if page_offsets else None
    return [Chunk(i, a, b, text[a:b], path, page(a), page(b - 1), count_tokens(text[a:b])) for i, (a, b, path) in enumerate(found)]


COLUMNS = "ordinal int, char_start int, char_end int, text string, heading_path array<string>, page_from int, page_to int, token_count int"
_ARROW = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32())
#: Texts whose chunks are handed on at once.
TEXTS = 500


def chunk_versions(versions: DataFrame, id_: str = "id", text: str = "text", headings: str | None = None, pages: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Rows of versions become rows of chunks; only the columns needed go to Python."""
    used = [id_, text, *[c for c in (headings, pages) if c]]
    schema = T.StructType([T.StructField("version_id", versions.schema[id_].dataType), *T._parse_datatype_string(COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                marks = part.column(2).to_pylist() if headings else [None] * part.num_rows
                offsets = part.column(len(used) - 1).to_pylist() if pages else [None] * part.num_rows
                at, made = [], []
                for i, (t, m, o) in enumerate(zip(part.column(1).to_pylist(), marks, offsets)):
                    own = chunk_text(t or "", [(h["start"], h["level"], h["text"]) for h in m or ()], o or [], limits)
                    at += [i] * len(own)
                    made += [(c.ordinal, c.start, c.end, c.text, c.heading_path, c.page_from, c.page_to, c.token_count) for c in own]
                columns = zip(*made) if made else [()] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, _ARROW)]], names=schema.names)

    return versions.select(*used).mapInArrow(run, schema)


def slice_back_failures(chunks: DataFrame, versions: DataFrame, id_: str = "id") -> DataFrame:
    """Chunks whose text is not the slice of the version: always none."""
    from pyspark.sql import functions as F

    v = versions.select(F.col(id_).alias("__v"), F.col("text").alias("__t"))
    joined = chunks.join(v, chunks["version_id"] == F.col("__v"), "left")
    again = F.substring("__t", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return joined.where(~again.eqNullSafe(chunks["text"])).select("version_id", "ordinal")

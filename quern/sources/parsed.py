"""What a parser returns, and the port that parsers follow."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol


@dataclass
class Parsed:
    text: str
    title: str | None = None
    headings: list[tuple[int, int, str]] = field(default_factory=list)  # start, level, text
    page_offsets: list[int] = field(default_factory=list)
    published_at: str | None = None
    authors: list[str] = field(default_factory=list)
    quality: float = 1.0
    warnings: list[str] = field(default_factory=list)
    parser: str = ""


class Parser(Protocol):
    name: str

    def can_parse(self, mime: str, path: str) -> bool: ...

    def parse(self, data: bytes, path: str) -> Parsed: ...


class Writer:
    """Collects text and remembers where headings begin."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.headings: list[tuple[int, int, str]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def line(self, text: str = "") -> None:
        self.put(text + "\n")

    def heading(self, level: int, text: str, mark: str = "") -> None:
        self.headings.append((self.size, level, text))
        self.line(mark + text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def table_rows(rows: list[list[str]], width: int | None = None) -> list[str]:
    """Pipe rows with a rule under the first; cells are escaped."""
    if not rows:
        return []
    n = width or len(rows[0])
    clean = [[str(c or "").replace("|", "\\|").replace("\n", " ").strip() for c in (r + [""] * n)[:n]] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return [lines[0], "| " + " | ".join(["---"] * n) + " |", *lines[1:]]

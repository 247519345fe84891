"""HTML: visible text with headings; what is hidden is reported."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from quern.sources.parsed import Parsed
from quern.sources.plain import decode, stem

BLOCKS = frozenset("p div section article header footer main aside nav ul ol li table tr blockquote pre figure form h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style noscript template svg canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NAMED = {"white": "ffffff", "black": "000000", "red": "ff0000", "green": "008000", "blue": "0000ff", "gray": "808080", "grey": "808080", "silver": "c0c0c0", "yellow": "ffff00", "transparent": ""}


_WHITE, _HEADING = re.compile(r"\s+"), re.compile("h[1-6]")


def _colour(value: str) -> str | None:
    v = value.strip().lower()
    if not v:
        return None
    if v in _NAMED:
        return _NAMED[v]
    if m := re.fullmatch(r"#([0-9a-f]{3})", v):
        return "".join(c * 2 for c in m.group(1))
    if m := re.fullmatch(r"#([0-9a-f]{6})", v):
        return m.group(1)
    if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", v):
        return "".join(f"{min(255, int(x)):02x}" for x in m.groups())
    return None


def _number(value: str) -> float | None:
    m = re.match(r"\s*(-?\d+(?:\.\d+)?)", value)
    return float(m.group(1)) if m else None


def hidden(attrs: dict[str, str | None]) -> bool:
    """Whether an element's own attributes keep readers from seeing it."""
    if not attrs:
        return False
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if not attrs.get("style"):
        return False
    style = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (d.partition(":") for d in (attrs.get("style") or "").split(";")) if v.strip())
    if style.get("display") == "none" or style.get("visibility") == "hidden":
        return True
    for name in ("opacity", "font-size"):
        if name in style and _number(style[name]) == 0:
            return True
    if (x := _number(style.get("text-indent", ""))) is not None and x <= -100:
        return True
    if any((x := _number(style.get(n, ""))) is not None and x <= -1000 for n in ("left", "top")):
        return True
    front, back = _colour(style.get("color", "")), _colour(style.get("background-color", style.get("background", "")))
    return bool(front) and front == back


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, hidden, dropped
        self.lines: list[str] = []
        self.size = 0
        self.headings: list[tuple[int, int, str]] = []
        self.found: list[str] = []
        self.title: list[str] = []
        self.open_heading: tuple[int, int, list[str]] | None = None
        self.hidden_text: list[str] | None = None

    def _put(self, line: str) -> None:
        if line == "" and (not self.lines or self.lines[-1] == ""):
            return
        self.lines.append(line)
        self.size += len(line) + 1

    def _report(self, text: str) -> None:
        text = _WHITE.sub(" ", text).strip()
        if text:
            self.found.append(f"hidden:{self.size}:{text[:400]}")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._put("")
        if tag in VOID:
            return
        up_hidden, up_dropped = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)
        now = up_hidden or hidden(dict(attrs))
        if now and not up_hidden:
            self.hidden_text = []
        self.stack.append((tag, now, up_dropped or tag in DROPPED))
        if _HEADING.fullmatch(tag) and not now and not self.stack[-1][2]:
            self.open_heading = (self.size, int(tag[1]), [])

    def handle_endtag(self, tag: str) -> None:
        if all(t != tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, was_hidden, _ = self.stack.pop()
            if was_hidden and not (self.stack and self.stack[-1][1]) and self.hidden_text is not None:
                self._report(" ".join(self.hidden_text))
                self.hidden_text = None
            if self.open_heading and t == f"h{self.open_heading[1]}":
                start, level, words = self.open_heading
                if words:
                    self.headings.append((start, level, " ".join(words)))
                self.open_heading = None
            if t == tag:
                break
        if tag in BLOCKS:
            self._put("")

    def handle_data(self, data: str) -> None:
        text = _WHITE.sub(" ", data).strip()
        if not text:
            return
        if self.stack and self.stack[-1][2]:
            return
        if self.stack and self.stack[-1][1]:
            if self.hidden_text is not None:
                self.hidden_text.append(text)
            return
        if any(t == "title" for t, _, _ in self.stack):
            self.title.append(text)
            return
        if self.open_heading:
            self.open_heading[2].append(text)
        self._put(text)

    def handle_comment(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self._report(data)


class HtmlParser:
    name = "html"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith((".html", ".htm", ".xhtml")) or mime in ("text/html", "application/xhtml+xml")

    def parse(self, data: bytes, path: str) -> Parsed:
        r = _Reader()
        r.feed(decode(data))
        r.close()
        while r.stack:
            r.handle_endtag(r.stack[-1][0])
        text = "\n".join(r.lines)
        first = next((t for _, level, t in r.headings if level == 1), None)
        return Parsed(text, " ".join(r.title) or first or stem(path), r.headings, warnings=r.found, parser=self.name)

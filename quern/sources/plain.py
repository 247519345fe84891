"""Text, Markdown, CSV, JSON and mail."""

from __future__ import annotations

import csv
import email
import email.policy
import email.utils
import io
import json
import re

from quern.errors import ParseError
from quern.sources.parsed import Parsed, Writer, table_rows

_ATX = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^([^\n#>|-][^\n]*)\n(=+|-+)[ \t]*$", re.M)


def decode(data: bytes) -> str:
    """UTF-8 (a byte-order mark dropped), else Windows-1252, else Latin-1."""
    for code in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def fold(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def stem(path: str) -> str:
    return path.replace("!", "/").rsplit("/", 1)[-1]


class TextParser:
    name = "text"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith((".txt", ".md", ".markdown", ".text", ".log", ".rst")) or mime.startswith("text/")

    def parse(self, data: bytes, path: str) -> Parsed:
        text = fold(decode(data))
        marks = [(m.start(), len(m.group(1)), m.group(2).strip()) for m in _ATX.finditer(text)]
        marks += [(m.start(), 1 if m.group(2)[0] == "=" else 2, m.group(1).strip()) for m in _SETEXT.finditer(text)]
        marks.sort()
        first = next((line.strip() for line in text.split("\n") if line.strip()), None)
        title = marks[0][2] if marks else first if first and len(first) <= 200 else None
        return Parsed(text, title, marks, parser=self.name)


class CsvParser:
    name = "csv"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith((".csv", ".tsv"))

    def parse(self, data: bytes, path: str) -> Parsed:
        delimiter = "\t" if path.lower().endswith(".tsv") else ","
        try:
            rows = [r for r in csv.reader(io.StringIO(fold(decode(data))), delimiter=delimiter) if r]
        except csv.Error as e:
            raise ParseError(f"not a table: {e}") from e
        return Parsed("\n".join(table_rows(rows)), stem(path), parser=self.name)


class JsonParser:
    name = "json"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith((".json", ".jsonl", ".ndjson"))

    def parse(self, data: bytes, path: str) -> Parsed:
        text = decode(data)
        try:
            values = [json.loads(text)] if path.lower().endswith(".json") else [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError as e:
            raise ParseError(f"not JSON: {e}") from e
        return Parsed("\n".join(json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False) for v in values), stem(path), parser=self.name)


class MailParser:
    name = "mail"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith((".eml", ".mbox")) or mime == "message/rfc822"

    def parse(self, data: bytes, path: str) -> Parsed:
        if data.startswith(b"From "):
            data = data.split(b"\n", 1)[-1]
        m = email.message_from_bytes(data, policy=email.policy.default)
        w = Writer()
        for name in ("From", "To", "Cc", "Date", "Subject"):
            if m[name]:
                w.line(f"{name}: {m[name]}")
        w.line()
        body = m.get_body(("plain", "html"))
        if body is not None:
            content = body.get_content()
            if body.get_content_subtype() == "html":
                content = re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", content))
            w.line(fold(content).strip("\n"))
        files = [p.get_filename() or "unnamed" for p in m.iter_attachments()]
        warnings = []
        if files:
            w.line()
            w.heading(2, "Attachments")
            for f in files:
                w.line(f)
                warnings.append(f"attachment not read: {f}")
        published = None
        if m["Date"]:
            try:
                published = email.utils.parsedate_to_datetime(str(m["Date"])).date().isoformat()
            except (TypeError, ValueError):
                warnings.append("the Date header cannot be read")
        return Parsed(w.text, str(m["Subject"]) if m["Subject"] else None, w.headings, published_at=published, authors=[str(m["From"])] if m["From"] else [], warnings=warnings, parser=self.name)

"""DOCX, XLSX and PPTX, read from their zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from quern.errors import ParseError
from quern.sources.parsed import Parsed, Writer, table_rows
from quern.sources.plain import stem

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"
TERMS = "{http://purl.org/dc/terms/}"
MOST = 512 << 20


class _Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError("not an Office package") from e

    def xml(self, name: str) -> ElementTree.Element | None:
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            return None
        if info.file_size > MOST:
            raise ParseError(f"{name} is too large")
        body = self.zip.read(info)
        if b"<!DOCTYPE" in body[:4096] or b"<!ENTITY" in body[:4096]:
            raise ParseError(f"{name} declares entities")
        try:
            return ElementTree.fromstring(body)
        except ElementTree.ParseError as e:
            raise ParseError(f"{name}: {e}") from e

    def links(self, name: str) -> dict[str, str]:
        folder, _, file = name.rpartition("/")
        root = self.xml(f"{folder}/_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            path = target[1:] if target.startswith("/") else f"{folder}/{target}"
            while "/../" in path:
                path = re.sub(r"[^/]+/\.\./", "", path, count=1)
            out[r.get("Id", "")] = path
        return out

    def core(self) -> tuple[str | None, list[str], str | None]:
        root = self.xml("docProps/core.xml")
        if root is None:
            return None, [], None
        title, who, made = (root.findtext(t) for t in (f"{DC}title", f"{DC}creator", f"{TERMS}created"))
        day = re.match(r"\d{4}-\d{2}-\d{2}", made or "")
        return title or None, [who] if who else [], day.group() if day else None


class DocxParser:
    name = "docx"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith(".docx")

    def _text(self, p: ElementTree.Element) -> str:
        out = []
        for e in p.iter():
            if e.tag == f"{W}t":
                out.append(e.text or "")
            elif e.tag == f"{W}tab":
                out.append("\t")
            elif e.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
        return "".join(out)

    def parse(self, data: bytes, path: str) -> Parsed:
        pack = _Package(data)
        body = pack.xml("word/document.xml")
        if body is None or (body := body.find(f"{W}body")) is None:
            raise ParseError("no document in the package")
        w = Writer()
        for e in body:  # in the body's order, tables where they stand
            if e.tag == f"{W}p":
                text = self._text(e)
                style = e.find(f"{W}pPr/{W}pStyle")
                kind = (style.get(f"{W}val") or "") if style is not None else ""
                m = re.fullmatch(r"[Hh]eading ?(\d?).*", kind)
                if kind.lower() == "title" and text.strip():
                    w.heading(1, text.strip())
                elif m and text.strip():
                    w.heading(min(6, int(m.group(1) or 2)), text.strip())
                elif text.strip():
                    w.line(text)
                w.line()
            elif e.tag == f"{W}tbl":
                rows = [[" ".join(self._text(p) for p in c.iter(f"{W}p")) for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]
                for line in table_rows(rows, max(map(len, rows), default=0) or None):
                    w.line(line)
                w.line()
        title, who, made = pack.core()
        return Parsed(w.text, title or (w.headings[0][2] if w.headings else stem(path)), w.headings, published_at=made, authors=who, parser=self.name)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


class XlsxParser:
    name = "xlsx"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith((".xlsx", ".xlsm"))

    def parse(self, data: bytes, path: str) -> Parsed:
        pack = _Package(data)
        book = pack.xml("xl/workbook.xml")
        if book is None:
            raise ParseError("no workbook in the package")
        strings = pack.xml("xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in i.iter(f"{S}t")) for i in strings.iter(f"{S}si")] if strings is not None else []
        links = pack.links("xl/workbook.xml")
        w = Writer()
        for sheet in book.iter(f"{S}sheet"):
            root = pack.xml(links.get(sheet.get(f"{R}id", ""), ""))
            w.heading(1, sheet.get("name", ""), "## ")
            w.line()
            rows = []
            for r in root.iter(f"{S}row") if root is not None else ():
                cells: dict[int, str] = {}
                for c in r.iter(f"{S}c"):
                    v = c.findtext(f"{S}v") or ""
                    if c.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                        v = shared[int(v)]
                    elif c.get("t") == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(f"{S}t"))
                    cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = v
                if any(v.strip() for v in cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            for line in table_rows(rows, max(map(len, rows), default=0) or None):
                w.line(line)
            w.line()
        title, who, made = pack.core()
        return Parsed(w.text, title or stem(path), w.headings, published_at=made, authors=who, parser=self.name)


class PptxParser:
    name = "pptx"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith(".pptx")

    def _paragraphs(self, root: ElementTree.Element) -> list[str]:
        return ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in root.iter(f"{A}p")]

    def parse(self, data: bytes, path: str) -> Parsed:
        pack = _Package(data)
        deck = pack.xml("ppt/presentation.xml")
        if deck is None:
            raise ParseError("no slides in the package")
        links = pack.links("ppt/presentation.xml")
        w, pages = Writer(), []
        for n, ref in enumerate(deck.iter(f"{P}sldId"), 1):
            name = links.get(ref.get(f"{R}id", ""), "")
            slide = pack.xml(name)
            if slide is None:
                continue
            head, rest = "", []
            for shape in slide.iter(f"{P}sp"):
                kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                lines = [x for x in self._paragraphs(shape) if x.strip()]
                if not head and kind is not None and kind.get("type") in ("title", "ctrTitle"):
                    head = " ".join(lines)
                else:
                    rest += lines
            pages.append(w.size)
            w.heading(2, f"Slide {n}: {head}", "## ")
            for line in rest:
                w.line(line)
            for target in pack.links(name).values():
                if "notesSlide" in target and (notes := pack.xml(target)) is not None:
                    said = [x for x in self._paragraphs(notes) if x.strip() and not x.strip().isdigit()]
                    if said:
                        w.line("[speaker notes] " + " ".join(said))
            w.line()
        title, who, made = pack.core()
        return Parsed(w.text, title or stem(path), w.headings, pages, made, who, parser=self.name)

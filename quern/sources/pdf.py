"""Born-digital PDF: text operators of each page's content, with the standard library."""

from __future__ import annotations

import re
import zlib

from quern.errors import ParseError
from quern.sources.parsed import Parsed
from quern.sources.plain import stem

PROBE = 0.6
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


#: A font's codes: the bytes of one, and the text of each.
Codes = tuple[int, dict[int, str]]


def _bytes(t: bytes) -> bytes:
    """What a string token stands for."""
    if t[:1] != b"(":
        digits = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        c = m.group(1)
        if c.isdigit():
            return bytes((int(c, 8) & 255,))
        return b"" if c in (b"\n", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, t[1:-1], flags=re.S)


def _string(t: bytes, font: Codes | None = None) -> str:
    body = _bytes(t)
    if font is not None:
        width, codes = font
        found = (int.from_bytes(body[i : i + width], "big") for i in range(0, len(body), width))
        # a code that the font does not explain is no text, but for a single byte
        return "".join(codes.get(c, chr(c) if width == 1 and 32 <= c < 127 else "") for c in found)
    return body.decode("utf-16-be", "replace") if body.startswith(b"\xfe\xff") else body.decode("cp1252", "replace")


def to_unicode(cmap: bytes) -> Codes:
    """The codes of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    number = lambda h: int(h, 16)
    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    width, codes = max(1, len(space.group(1)) // 2) if space else 1, {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", part):
            codes[number(code)] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for first, last, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            each = re.findall(rb"<([0-9A-Fa-f]*)>", many)
            for k, code in enumerate(range(number(first), min(number(last), number(first) + 0xFFFF) + 1)):
                if many:
                    if k < len(each):
                        codes[code] = text(each[k])
                else:
                    start = text(to)
                    codes[code] = start[:-1] + chr(min(ord(start[-1]) + k, 0x10FFFF)) if start else ""
    return width, codes


def page_text(content: bytes, fonts: dict[bytes, Codes] | None = None) -> str:
    """Shown strings, by the codes of their fonts; moves to another line become line feeds."""
    out: list[str] = []
    stack: list[bytes] = []
    font: Codes | None = None
    for m in _TOKEN.finditer(content):
        t = m.group()
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            stack.append(t)
            continue
        if t == b"Tf":
            names = [s[1:] for s in stack if s[:1] == b"/"]
            font = (fonts or {}).get(names[-1]) if names else None
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for s in stack:
                if s[:1] in b"(<":
                    out.append(_string(s, font))
                elif t == b"TJ" and s[:1] not in b"[]/" and float(s) < -200:
                    out.append(" ")
        elif t == b"T*" or t in (b"Td", b"TD") and len(stack) >= 2 and stack[-1] not in (b"0", b"0.0"):
            out.append("\n")
        elif t in (b"Tm", b"ET"):
            out.append("\n")
        stack.clear()
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


class PdfParser:
    name = "pdf"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith(".pdf") or mime == "application/pdf"

    def parse(self, data: bytes, path: str) -> Parsed:
        if not data.lstrip()[:5] == b"%PDF-":
            raise ParseError("not a PDF")
        objects = {int(n): body for n, _, body in _OBJECT.findall(data)}
        for body in list(objects.values()):  # objects inside object streams
            if b"/ObjStm" in body and (s := self._stream(body)) is not None:
                n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body).group(1)) for k in (b"N", b"First"))
                head = list(map(int, s[:first].split()[: 2 * n]))
                ends = head[3::2] + [len(s) - first]
                for num, at, end in zip(head[::2], head[1::2], ends):
                    objects.setdefault(num, s[first + at : first + end])
        if b"/Encrypt" in data:
            raise ParseError("the PDF is encrypted")
        texts, offsets, warnings, size, density = [], [], [], 0, []
        for n, page in enumerate(self._pages(objects), 1):
            try:
                refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
                streams = [self._stream(objects[int(r)]) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1))] if refs else []
                text = page_text(b"\n".join(s for s in streams if s), self._fonts(page, objects))
            except (KeyError, ValueError, zlib.error) as e:
                text = ""
                warnings.append(f"page {n} cannot be read: {e}")
            offsets.append(size)
            texts.append(text)
            size += len(text) + 2
            box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", page)
            a, b, c, d = (float(x) for x in box.groups()) if box else (0, 0, 612, 792)
            density.append(min(1.0, len(text) / max(1.0, (c - a) * (d - b)) * 400))
        if not texts:
            raise ParseError("the PDF has no pages")
        quality = sum(density) / len(density)
        if quality < 0.1:
            warnings.append("almost no text: scanned pages?")
        elif quality < PROBE:
            warnings.append("little text for its pages")
        found = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\))", data)
        return Parsed("\n\n".join(texts), (_string(found.group(1)) if found else "") or stem(path), page_offsets=offsets, quality=round(quality, 6), warnings=warnings, parser=self.name)

    def _stream(self, body: bytes) -> bytes | None:
        m = _STREAM.search(body)
        if not m:
            return None
        return zlib.decompressobj().decompress(m.group(1)) if b"/FlateDecode" in body else m.group(1)

    def _fonts(self, page: bytes, objects: dict[int, bytes]) -> dict[bytes, Codes]:
        """The codes of the page's fonts that have a ToUnicode map; resources may be an
        object of their own, or those of a parent."""

        def inside(body: bytes, name: bytes) -> bytes:
            """The dictionary under a name, wherever it is."""
            m = re.search(rb"/%s\s*(?:(\d+)\s+\d+\s+R|(?=<<))" % name, body)
            if not m:
                return b""
            if m.group(1):
                return objects.get(int(m.group(1)), b"")
            depth = 0
            for x in re.finditer(rb"<<|>>", body[m.end() :]):
                depth += 1 if x.group() == b"<<" else -1
                if depth == 0:
                    return body[m.end() : m.end() + x.end()]
            return body[m.end() :]

        seen, at = 0, page
        while not (resources := inside(at, b"Resources")) and seen < 50:
            up = re.search(rb"/Parent\s+(\d+)", at)
            if not up or int(up.group(1)) not in objects:
                break
            at, seen = objects[int(up.group(1))], seen + 1
        out: dict[bytes, Codes] = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", inside(resources, b"Font")):
            m = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(ref), b""))
            stream = self._stream(objects.get(int(m.group(1)), b"")) if m else None
            if stream is not None:
                out[name] = to_unicode(stream)
        return out

    def _pages(self, objects: dict[int, bytes]) -> list[bytes]:
        """Pages in the tree's order, else in the file's."""
        out: list[bytes] = []
        seen: set[int] = set()

        def visit(n: int) -> None:
            if n in seen or n not in objects:
                return
            seen.add(n)
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", objects[n])
            if kids:
                for k in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1)):
                    visit(int(k))
            elif re.search(rb"/Type\s*/Page\b", objects[n]):
                out.append(objects[n])

        for body in objects.values():
            if re.search(rb"/Type\s*/Catalog\b", body) and (m := re.search(rb"/Pages\s+(\d+)", body)):
                visit(int(m.group(1)))
        return out or [b for b in objects.values() if re.search(rb"/Type\s*/Page\b", b)]

"""Which parser reads what: the first that claims a file; text is the last resort."""

from __future__ import annotations

import mimetypes

from quern.errors import UnsupportedFormat
from quern.sources.html import HtmlParser
from quern.sources.office import DocxParser, PptxParser, XlsxParser
from quern.sources.parsed import Parsed, Parser
from quern.sources.pdf import PdfParser
from quern.sources.plain import CsvParser, JsonParser, MailParser, TextParser
from quern.sources.rtf import RtfParser

UNREAD = (".doc", ".xls", ".ppt", ".pages", ".odt")
PARSERS: list[Parser] = [PdfParser(), DocxParser(), XlsxParser(), PptxParser(), RtfParser(), HtmlParser(), CsvParser(), JsonParser(), MailParser(), TextParser()]


def guess_mime(path: str) -> str:
    return mimetypes.guess_type(path.rsplit("!", 1)[-1])[0] or "application/octet-stream"


def parse(data: bytes, path: str, parsers: list[Parser] | None = None) -> Parsed:
    mime = guess_mime(path)
    for p in parsers or PARSERS:
        if p.can_parse(mime, path):
            return p.parse(data, path)
    end = next((s for s in UNREAD if path.lower().endswith(s)), None)
    raise UnsupportedFormat(f"{end} files are not read; save as a newer format" if end else f"no parser for {mime}: {path}")

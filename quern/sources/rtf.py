"""RTF: a small machine over groups, control words and text."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, replace

from quern.errors import ParseError
from quern.sources.parsed import Parsed
from quern.sources.plain import stem

_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
SKIPPED = frozenset("fonttbl colortbl info pict object themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl latentstyles header footer headerl headerr footerl footerr footnote annotation atnid atnauthor fldinst bkmkstart bkmkend nonshppict".split())
WARNED = {"pict": "an image", "object": "an object", "footnote": "a footnote", "annotation": "an annotation"}
_LITERAL = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}


@dataclass(frozen=True)
class _State:
    skip: bool = False
    hidden: bool = False
    uc: int = 1
    sheet: bool = False


class RtfParser:
    name = "rtf"

    def can_parse(self, mime: str, path: str) -> bool:
        return path.lower().endswith(".rtf") or mime in ("application/rtf", "text/rtf")

    def parse(self, data: bytes, path: str) -> Parsed:
        if not data.lstrip().startswith(b"{\\rtf"):
            raise ParseError("not RTF")
        codec = "cp1252"
        stack, state = [], _State()
        out: list[str] = []
        size = 0
        levels: dict[int, int] = {}  # style number -> heading level
        style, name, style_level = None, "", 0
        level, para_start = 0, 0
        headings: list[tuple[int, int, str]] = []
        warnings: list[str] = []
        hidden: list[str] = []
        pending, high, star, depth = 0, "", False, 0

        def put(text: str) -> None:
            nonlocal size, name
            if state.sheet:
                name += text
            elif state.skip:
                return
            elif state.hidden:
                hidden.append(text)
            else:
                if hidden:
                    if "".join(hidden).strip():
                        warnings.append(f"hidden:{size}:{''.join(hidden)[:400]}")
                    hidden.clear()
                out.append(text)
                size += len(text)

        def paragraph() -> None:
            nonlocal para_start
            text = "".join(out)[para_start:] if level else ""
            if level and text.strip():
                headings.append((para_start, level, text.strip()))
            put("\n")
            para_start = size

        for m in _TOKEN.finditer(data):
            word, number, hexed, symbol, brace, text = m.groups()
            if brace == b"{":
                stack.append(state)
                depth += 1
                star = False
                continue
            if brace == b"}":
                if state.sheet and len(stack) and stack[-1].sheet and style is not None:
                    label = name.strip().rstrip(";").lower()
                    found = re.match(r"heading (\d)", label)
                    got = int(found.group(1)) if found else 1 if label == "title" else style_level
                    if got:
                        levels[style] = min(6, got)
                    style, name, style_level = None, "", 0
                if not stack:
                    break
                state = stack.pop()
                depth -= 1
                continue
            if symbol == b"*":
                star = True
                continue
            if word:
                w, n = word.decode(), int(number) if number else None
                pending_was, pending = pending, 0
                if w == "u" and n is not None:
                    n &= 0xFFFF
                    if 0xD800 <= n < 0xDC00:
                        high = chr(n)
                    elif 0xDC00 <= n < 0xE000 and high:
                        put(chr(0x10000 + ((ord(high) - 0xD800) << 10) + n - 0xDC00))
                        high = ""
                    elif not 0xD800 <= n < 0xE000:
                        put(chr(n))
                    pending = state.uc
                elif w == "uc":
                    state = replace(state, uc=n or 0)
                elif w == "ansicpg" and n:
                    try:
                        codec = codecs.lookup(f"cp{n}").name
                    except LookupError:
                        warnings.append(f"unknown code page {n}")
                elif w == "stylesheet":
                    state = replace(state, sheet=True)
                elif state.sheet and w in ("s", "cs", "ds"):
                    style = n if w == "s" else None
                elif state.sheet and w == "outlinelevel":
                    style_level = (n or 0) + 1
                elif w in SKIPPED or star and w not in ("shppict",):
                    if w in WARNED and not state.skip:
                        warnings.append(f"{WARNED[w]} was left out")
                    state = replace(state, skip=True)
                elif state.skip or state.sheet:
                    pass
                elif w in ("v", "deleted"):
                    state = replace(state, hidden=n != 0)
                elif w == "plain":
                    state = replace(state, hidden=False)
                elif w == "par" or w == "sect":
                    paragraph()
                elif w == "pard":
                    level = 0
                elif w == "s":
                    level = levels.get(n, 0)
                elif w == "outlinelevel":
                    level = min(6, (n or 0) + 1)
                elif w in ("cell", "nestcell"):
                    put(" | ")
                elif w in ("row", "nestrow"):
                    put("\n")
                elif w in _LITERAL:
                    put(_LITERAL[w])
                elif w == "bin":
                    pending = pending_was
                star = False
                continue
            star = False
            if hexed:
                if pending:
                    pending -= 1
                else:
                    put(bytes.fromhex(hexed.decode()).decode(codec, "replace"))
            elif symbol:
                if pending:
                    pending -= 1
                elif symbol in b"\\{}":
                    put(symbol.decode())
                elif symbol == b"~":
                    put("\u00a0")
                elif symbol in (b"\n", b"\r"):
                    paragraph()
                elif symbol == b"_":
                    put("-")
            elif text:
                plain = text.decode(codec, "replace")
                cut = min(pending, len(plain))
                pending -= cut
                if plain[cut:]:
                    put(plain[cut:])
        if depth:
            warnings.append("a group is not closed")
        whole = "".join(out)
        if level and whole[para_start:].strip():
            headings.append((para_start, level, whole[para_start:].strip()))
        if hidden and "".join(hidden).strip():
            warnings.append(f"hidden:{size}:{''.join(hidden)[:400]}")
        return Parsed(whole, headings[0][2] if headings else stem(path), headings, quality=0.8, warnings=warnings, parser=self.name)

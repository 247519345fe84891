"""Personal data: detection and keyed, type-consistent surrogates.

Detected are e-mail addresses, telephone numbers, IPv4 addresses, card numbers,
social-security numbers, IBANs, access keys, assigned secrets, and names: what
follows a title, what begins with a known given name, a known given name alone, and
in the same text any further mention of a word that is so found to be a name.  After
a title all words but the last are given names of the title's gender, up to three
words; a given name takes one more with it.  Names are found by lists, not by a
model: a name without title, known given name or other mention is left, and so are
bare surnames in other texts.  An entity is known by its kind and canonical form
(digits of a number, lower case of an address or name; a secret that has the form of
an access key is one), so all its mentions in the corpus get one surrogate
(coreference), each written in the mention's own format: punctuation, letter case,
script and number of digits stay; a card number keeps its Luhn validity, an address
its reserved domain, an IP its private range, a given name its gender, a name its
script.

Surrogates come from a keyed hash of (kind, canonical form, attempt).  The key is the
caller's (``spark.quern.surrogate.key`` for the queries) or drawn anew for each run.
The entities of the whole corpus are gathered once: where two would get one
surrogate, or a surrogate is itself some entity of the corpus, all but the first in
order go to the next attempt, until none collides (distinctness).  From the
``WIDER``-th attempt on the range is widened (other private addresses, more digits or
letters), so that a full range is left; if ``ATTEMPTS`` do not do, that is an error.
Later attempts go to the executors if they have ``BROADCAST_BYTES`` at most, else to
their texts by a join; texts are rewritten where they are.

Defined cases: a null text stays null and an empty one empty; rows are
independent otherwise, so repeated rows get the same text; other columns are
handed on as they are, except n_chars, which follows the text; an empty table
stays empty.  Overlapping detections: the one that starts first, then the longer,
wins.  Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import textbytes
from quern.llm.common import cut, fresh, map_rows

KEY_SETTING = "spark.quern.surrogate.key"
ATTEMPTS = 128
WIDER = 8
BROADCAST_BYTES = 32 << 20

_EMAIL = re.compile(r"[^\W_][\w.+%-]*@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,}")
_STRUCTURED = re.compile(
    r"""(?P<SECRET>(?:(?<=[^A-Za-z0-9])|^)(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_?KEY)["']?\s*[:=]\s*["']?(?P<VALUE>[^\s"',;]{5,}))
    |(?P<KEY>(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{12,20}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9]))
    |(?P<IBAN>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<IP>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))
    |(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<PHONE>(?<![\w])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3,4}[ .-]\d{4})(?!\w))
    |(?P<CARD>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]))""",
    re.X,
)
_MARK = np.zeros(256, bool)
_MARK[48:58] = _MARK[[ord(c) for c in "@=:"]] = True
#: The first two bytes of the non-ASCII decimal digits, as one number, and their first bytes.
_DIGIT = np.zeros(1 << 16, bool)
_DIGIT[[b[0] << 8 | b[1] for b in (chr(c).encode() for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")]] = True
_DIGIT_LEAD = _DIGIT.reshape(256, 256).any(1)
_LETTERISH = np.zeros(256, bool)
_LETTERISH[65:91] = _LETTERISH[97:123] = _LETTERISH[48:58] = _LETTERISH[128:] = True
_LETTERISH[[ord(c) for c in "_'-"]] = True
#: Capitals of the three scripts, and those of two bytes by these as one number.
_CAPITALS = [c for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]) if unicodedata.category(c) == "Lu" and unicodedata.name(c).startswith(("LATIN", "GREEK", "CYRILLIC"))]
_CAPITAL = np.zeros(1 << 16, bool)
_CAPITAL[[b[0] << 8 | b[1] for b in (c.encode() for c in _CAPITALS) if len(b) == 2]] = True
_UPPER = "A-Z" + "".join(_CAPITALS)
# a full stop within a run is that of an abbreviated title
_RUN = re.compile(rf"(?<![\w'-])[{_UPPER}](?:[\w'’-]{{0,4}}\.|[\w'’-]*)(?: [{_UPPER}](?:[\w'’-]{{0,4}}\.|[\w'’-]*))+")
_WORD = re.compile(rf"(?<![\w'’-])[{_UPPER}][\w'’-]*")
_TITLES = {
    **dict.fromkeys(("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "Don", "Господин", "Κύριος", "Κύριο"), "M"),
    **dict.fromkeys(("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle", "Lady", "Doña", "Госпожа", "Κυρία"), "F"),
    **dict.fromkeys(("Dr", "Prof", "Mx", "Professor", "Doctor"), "N"),
}
_GIVEN = {
    **dict.fromkeys("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul George Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Jacques Michel André Carlos José Juan Antonio Manuel Luis Ivan Иван Сергей Дмитрий Алексей Γιώργος Νίκος".split(), "M"),
    **dict.fromkeys("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Alice Laura Julia Ursula Sabine Petra Monika Marie Claire Sophie Isabelle María Carmen Lucía Ana Olga Анна Мария Елена Ольга Μαρία Ελένη".split(), "F"),
}
#: First four bytes of the given names (all have four or more), as written and in capitals.
_GIVEN_HEADS = np.unique([int.from_bytes(x.encode()[:4], "big") for n in _GIVEN if len(n.encode()) >= 4 for x in (n, n.upper())])
_GIVEN_SHORT = np.unique([int.from_bytes(x.encode()[:3], "big") for n in _GIVEN if len(n.encode()) < 4 for x in (n, n.upper())])
_FOLDED = {n.lower(): g for n, g in _GIVEN.items()}
_SOUNDS = {
    "latin": (list("bcdfglmnprstv") + ["br", "st", "kl"], list("aeiou"), {"M": ["o", "an", "is"], "F": ["a", "ine", "ia"], "N": ["e", "en"], "S": ["n", "r", "s", "l", "ck"]}),
    "cyrillic": (list("бвгдлмнпрстк"), list("аеиоу"), {"M": ["ан", "ор"], "F": ["а", "ия"], "N": ["ен"], "S": ["н", "р", "в", "к"]}),
    "greek": (list("βγδλμνπρστκ"), list("αειο"), {"M": ["ος", "ας"], "F": ["α", "η"], "N": ["ιν"], "S": ["ς", "ου", "ης"]}),
}


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _bare(word: str) -> str:
    word = word.rstrip(".")
    return word[:-2] if word.endswith(("'s", "’s")) else word


def _given(bare: str) -> str | None:
    """The gender of a known given name, written with a capital or in capitals."""
    return _GIVEN.get(bare) or (_FOLDED.get(bare.lower()) if bare.isupper() else None)


def _run_names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names in runs of capitalised words: after titles and given names."""
    for m in _RUN.finditer(text):
        gender, room, held, at = "", 0, [], m.start()

        def flush() -> Iterator[tuple[int, int, str, str]]:
            for i, (a, bare, known) in enumerate(held):  # noqa: B023
                last = i == len(held) - 1 and (i > 0 or not known)  # noqa: B023
                yield a, a + len(bare), "SURNAME" if last else "GIVEN_" + (known or gender or "N"), bare.lower()  # noqa: B023

        for word in m.group().split(" "):
            bare = _bare(word)
            known = _given(bare)
            if bare in _TITLES:
                yield from flush()
                kind = _TITLES[bare]
                gender, room, held = kind if kind != "N" or not room else gender, 3, []
            elif len(bare) > 1 and (room or known):
                if not room:
                    gender, room = known, 2
                held.append((at, bare, known))
                room -= 1
                if word.endswith(".") or not room:
                    yield from flush()
                    gender, room, held = "", 0, []
            at += len(word) + 1
        yield from flush()


def _names(text: str, paired: bool, named: bool) -> list[tuple[int, int, str, str]]:
    found = list(_run_names(text)) if paired else []
    if not found and not named:
        return found
    kinds = {c: k for *_, k, c in reversed(found)}
    # the same words elsewhere in the text, and given names alone
    for m in _WORD.finditer(text):
        bare = _bare(m.group())
        kind = kinds.get(bare.lower()) or ("GIVEN_" + g if (g := _given(bare)) else None)
        if kind and len(bare) > 1:
            found.append((m.start(), m.start() + len(bare), kind, bare.lower()))
    return found


def canonical(kind: str, value: str) -> str:
    if kind in ("PHONE", "CARD", "SSN"):
        return re.sub(r"\D", "", value)
    if kind == "IBAN":
        return value.replace(" ", "")
    return value.lower() if kind == "EMAIL" else value


def find(text: str | None, marked: bool = True, paired: bool = True, named: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order, not overlapping.
    marked, paired, named: what ``suspects`` says of the text."""
    if not text:
        return []
    found = []
    if marked:
        if "@" in text:
            found += [(*m.span(), "EMAIL", canonical("EMAIL", m.group())) for m in _EMAIL.finditer(text)]
        for m in _STRUCTURED.finditer(text):
            kind = "SECRET" if m.group("SECRET") else m.lastgroup
            a, b = m.span("VALUE") if kind == "SECRET" else m.span()
            if kind == "SECRET" and (whole := _STRUCTURED.fullmatch(text[a:b])) and whole.lastgroup == "KEY":
                kind = "KEY"
            if kind == "PHONE" and sum(c.isdigit() for c in m.group()) < 7:
                continue
            found.append((a, b, kind, canonical(kind, text[a:b])))
    if paired or named:
        found += _names(text, paired, named)
    if len(found) < 2:
        return found
    out, end = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def suspects(column: pa.Array) -> list[tuple[int, bool, bool, bool]]:
    """(row, marked, paired, named) of the texts that may hold an entity: marked by a
    digit of any script, "@", "=" or ":", with two words in a row that begin with a
    capital, only a blank between, or a full stop and a blank after one of five
    letters at most, or with a word that begins as a known given name.  No other
    text holds one."""
    raw, off = textbytes.buffers(column)
    out: list[tuple[int, bool, bool, bool]] = []
    for a, b in textbytes.slices(off):
        part, po = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        if len(part) == 0:
            continue
        marked = np.zeros(b - a, bool)
        marked[np.searchsorted(po, np.flatnonzero(_MARK[part]), side="right") - 1] = True
        lead = np.flatnonzero(_DIGIT_LEAD[part[:-1]])
        lead = lead[_DIGIT[part[lead].astype(np.int64) << 8 | part[lead + 1]]]
        marked[np.searchsorted(po, lead, side="right") - 1] = True
        inside = _LETTERISH[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        rows = po[:-1][po[:-1] < len(part)]  # a row may begin where another ends in a letter
        starts[rows] = inside[rows]
        begin = np.flatnonzero(starts)
        first = part[begin]
        after = part[np.minimum(begin + 1, len(part) - 1)]
        # of three bytes any that E1 begins may be one
        capital = (first >= 65) & (first <= 90) | _CAPITAL[first.astype(np.int64) << 8 | after] | (first == 0xE1)
        heads = begin[capital & (begin + 3 <= len(part))]
        four = np.zeros(len(heads), np.int64)
        for k in range(4):
            four = four << 8 | part[np.minimum(heads + k, len(part) - 1)]
        given = heads[np.isin(four, _GIVEN_HEADS) | np.isin(four >> 8, _GIVEN_SHORT)]
        named = np.zeros(b - a, bool)
        named[np.searchsorted(po, given, side="right") - 1] = True
        pair = np.flatnonzero(capital[1:] & capital[:-1])
        x, y = begin[pair], begin[pair + 1]
        near = part[y - 1] == 32
        x, y = x[near], y[near]
        before = part[np.maximum(y - 2, 0)]
        y = y[_LETTERISH[before] | (before == 46) & (y - 2 - x <= 10)]
        paired = np.zeros(b - a, bool)
        paired[np.searchsorted(po, y, side="right") - 1] = True
        out += [(a + int(i), bool(marked[i]), bool(paired[i]), bool(named[i])) for i in np.flatnonzero(marked | paired | named)]
    return out


class _Stream:
    """Numbers from a keyed hash; as many as wanted."""

    def __init__(self, key: bytes, *parts: object):
        self.key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
        self.parts, self.block, self.pool = "\x00".join(map(str, parts)).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < n << 24:
            self.pool = int.from_bytes(hashlib.blake2b(self.parts + self.block.to_bytes(4, "big"), key=self.key).digest(), "big")
            self.left, self.block = 1 << 512, self.block + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def _alike(value: str, s: _Stream, hexadecimal: bool = False) -> str:
    """Each digit a digit, each letter a letter of its case and script."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(chr(ord(c) - unicodedata.digit(c, 0) + s.below(10)) if not c.isascii() else str(s.below(10)))
        elif hexadecimal and c.isalpha():
            out.append(("abcdef" if c.islower() else "ABCDEF")[s.below(6)])
        elif c.isalpha():
            low = "абвгдежзиклмнопрст" if _script(c) == "cyrillic" else "αβγδεζηθικλμνοπρσ" if _script(c) == "greek" else "abcdefghijklmnopqrstuvwxyz"
            n = low[s.below(len(low))]
            out.append(n.upper() if c.isupper() else n)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or one of this run only."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate."""
    s = _Stream(key, kind, canon, attempt)
    wide = attempt // WIDER
    longer = canon + "0" * max(0, wide - 3)  # of numbers, when nothing else helps
    if kind == "EMAIL":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] in ("example", "test") or len(labels[-2]) <= 2 and len(labels) > 2 else 1
        head = ".".join(labels[:-keep])
        inner = _alike(head, _Stream(key, "DOMAIN", domain)) if head else ""
        return f"{_alike(local + 'a' * wide, s)}@{inner}{'.' if inner else ''}{'.'.join(labels[-keep:])}"
    if kind == "IP":
        a, b, *_ = octets = [int(x) for x in canon.split(".")]
        fixed = 1 if a in (10, 127) else 2 if (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else 0
        if fixed and wide:
            octets, fixed = ([10], 1) if wide == 1 else (octets, 0)
        made = [s.below(256) for _ in range(4)]
        if not fixed:
            made[0] = [x for x in range(1, 224) if x not in (10, 127, 172, 192)][made[0] * 219 // 256]
        return ".".join(map(str, octets[:fixed] + made[fixed:]))
    if kind == "CARD":
        zero = [ord(c) - unicodedata.digit(c) for c in canon]
        body = "".join(chr(z + s.below(10)) for z in zero)
        body = canon[0] + body[1:]
        if luhn(body) != luhn(canon):
            for d in range(10):
                if luhn(body[:-1] + chr(zero[-1] + d)) == luhn(canon):
                    return body[:-1] + chr(zero[-1] + d)
        return body
    if kind == "PHONE":
        made = _alike(longer, s)
        keep = len(canon) - 10 if len(canon) > 10 else 0
        made = canon[:keep] + made[keep:]
        return made[:-7] + "555" + made[-4:] if canon[-7:-4] == "555" and not wide else made
    if kind == "IBAN":
        return canon[:2] + _alike(longer[2:], s)
    if kind == "KEY":
        head = next((p for p in ("AKIA", "sk-") if canon.startswith(p)), canon[:4] if canon.startswith("gh") else "")
        return head + _alike(canon[len(head) :] + canon[-1] * wide, s, re.fullmatch(r"[0-9a-fA-F]+", canon) is not None)
    if kind == "SECRET":
        return _alike(canon + "a" * wide, s, re.fullmatch(r"[0-9a-fA-F]{16,}", canon) is not None)
    if kind == "SSN":
        return _alike(longer, s)
    onset, vowel, ends = _SOUNDS[_script(canon)]
    end = ends["S" if kind == "SURNAME" else kind[-1]]
    body = "".join(onset[s.below(len(onset))] + vowel[s.below(len(vowel))] for _ in range((3 if kind == "SURNAME" else 2) + attempt // 2))
    return body + (end if kind == "SURNAME" else [onset[s.below(len(onset))] + e for e in end])[s.below(len(end))]


def written(mention: str, kind: str, made: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind in ("PHONE", "CARD", "SSN", "IBAN"):
        left = iter(made)
        return "".join(next(left, c) if c.isalnum() else c for c in mention) + "".join(left)
    if kind == "EMAIL":
        return made.upper() if mention.isupper() else "".join(m.upper() if c.isupper() else m for m, c in zip(made, mention)) if len(made) == len(mention) else made
    if kind == "SURNAME" or kind.startswith("GIVEN"):
        return made.upper() if mention.isupper() and len(mention) > 1 else made.capitalize()
    return made


def replaced(text: str | None, later: dict[tuple[str, str], int], key: bytes, marked: bool = True, paired: bool = True, named: bool = True) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    found = find(text, marked, paired, named)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canon in found:
        out += [text[at:a], written(text[a:b], kind, surrogate(kind, canon, later.get((kind, canon), 0), key))]
        at = b
    return "".join(out) + text[at:], len(found)


_ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("canon", T.StringType())])


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon) of the corpus."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen = sorted({x[2:] for i, *how in suspects(batch.column(0)) for x in find(batch.column(0)[i].as_py(), *how)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canon"])

    return map_rows(docs.select("text"), _ENTITY, run).distinct()


def assign(found: DataFrame, key: bytes, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, canon, attempt, made) of distinct entities, without collisions.

    What is settled stays; only what collides goes to the next round."""
    schema = T.StructType([*_ENTITY.fields, T.StructField("attempt", T.IntegerType()), T.StructField("made", T.StringType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([surrogate(k, c, n, key) for k, c, n in rows], pa.string())], names=schema.names)

    todo = cut(map_rows(found.withColumn("attempt", F.lit(0)), schema, run))
    taken, settled = [todo.select("kind", F.col("canon").alias("made"))], []
    order = Window.partitionBy("kind", "made").orderBy("canon")
    for _ in range(attempts):
        busy = None
        for t in taken:  # only what meets a new surrogate; those are few after the first round
            hit = t.join(todo.select("kind", "made").distinct(), ["kind", "made"], "left_semi")
            busy = hit if busy is None else busy.unionByName(hit)
        busy = busy.distinct().withColumn("busy", F.lit(True))
        ranked = todo.withColumn("n", F.row_number().over(order)).join(busy, ["kind", "made"], "left")
        ranked = cut(ranked.select("kind", "canon", "attempt", "made", ((F.col("n") > 1) | F.col("busy").isNotNull()).alias("again")))
        done = ranked.where("NOT again").drop("again")
        settled.append(done)
        again = ranked.where("again")
        if again.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        taken = [*taken[:1], cut(reduce(DataFrame.unionByName, settled).select("kind", "made"))]
        todo = cut(map_rows(again.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), schema, run))
    raise RuntimeError(f"{todo.count()} entities have no surrogate of their own after {attempts} attempts")


def rewrite(docs: DataFrame, key: bytes, broadcast_bytes: int = BROADCAST_BYTES, counted: str | None = None) -> DataFrame:
    """``docs`` with surrogates in text; ``counted`` names a further column with
    the number of entities replaced."""
    if counted is not None:  # a column of that name, in any case, makes way
        docs = docs.select(*[c for c in docs.columns if c.lower() != counted.lower()])
    later = cut(assign(entities(docs), key).where("attempt > 0").select("kind", "canon", "attempt"))
    size = later.agg(F.coalesce(F.sum(F.octet_length("canon") + 64), F.lit(0))).first()[0]
    known = {(k, c): n for k, c, n in later.collect()} if size <= broadcast_bytes else None
    schema = T.StructType(list(docs.schema.fields) + ([T.StructField(counted, T.IntegerType())] if counted else []))
    names, source = docs.columns, docs
    if known is None:
        pair = T.StructType([T.StructField("__h", T.LongType()), *_ENTITY.fields])

        def mentions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [(batch.column(0)[i].as_py(), *x) for i, *how in suspects(batch.column(1)) for x in {e[2:] for e in find(batch.column(1)[i].as_py(), *how)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=pair.names)

        hashed = docs.select(F.xxhash64("text").alias("__h"), "text")
        own = map_rows(hashed, pair, mentions).distinct().join(later, ["kind", "canon"])
        hash_, mine = fresh(docs, "__text_hash"), fresh(docs, "__later")
        own = own.groupBy(F.col("__h").alias(hash_)).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(mine))
        source = docs.join(own, F.xxhash64(docs["text"]) == F.col(hash_), "left").select(*[docs[c] for c in names], mine)
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = list(batch.columns[: len(names)])
        text, where, texts, counts = columns[at], [], [], np.zeros(batch.num_rows, np.int32)
        for i, *how in suspects(text):
            own = known if known is not None else {(x["kind"], x["canon"]): x["attempt"] for x in batch.column(len(names))[i].as_py() or ()}
            new, n = replaced(text[i].as_py(), own, key, *how)
            if n:
                where.append(i)
                texts.append(new)
                counts[i] = n
        if where:
            mask = pa.array(counts > 0)
            columns[at] = pc.replace_with_mask(text, mask, pa.array(texts, text.type))
            if size is not None:
                columns[size] = pc.replace_with_mask(columns[size], mask, pa.array([len(x) for x in texts], columns[size].type))
        if counted:
            columns.append(pa.array(counts))
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_rows(source, schema, run)

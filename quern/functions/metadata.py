"""Document metadata as expressions: title, date, type, meeting, misses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_M = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
#: Parts (year, month, day) of each way to write a date, in order of trust.
DATE_PATTERNS = (
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", (1, 2, 3)),
    (rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)? ({_M})[a-z]*\.? (\d{{4}})\b", (3, 2, 1)),
    (rf"(?i)\b({_M})[a-z]*\.? (\d{{1,2}})(?:st|nd|rd|th)?, (\d{{4}})\b", (3, 1, 2)),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 2, 1)),
)
#: A word of a type's name -> the type; the first found decides.
TYPE_HINTS = (("minutes", "minutes"), ("agenda", "agenda"), ("register", "register"), ("policy", "policy"), ("briefing", "briefing"), ("report", "report"), ("terms of reference", "terms"), ("note", "note"), ("email", "email"))
SUFFIX_TYPES = {"eml": "email", "csv": "register", "tsv": "register", "xlsx": "register", "pptx": "briefing"}
BODIES = ("Sub-Committee", "Working Group", "Task Force", "Committee", "Board", "Cabinet", "Council", "Panel", "Group", "Programme", "Project", "Forum", "Commission", "Partnership", "Team")
MEETING = rf"\b((?:[A-Z][\p{{L}}&'-]*\s+){{0,4}}(?:{'|'.join(BODIES)}))\b"
REQUIRED = ("title", "published_at", "doc_type", "meeting_or_project", "uri")


def _month(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(F.substring(c, 1, 3)) == m[:3].lower(), F.lit(f"{i:02d}")) for i, m in enumerate(MONTHS, 1)], F.lpad(c, 2, "0"))


def first_date(c: Column) -> Column:
    """The date that the most trusted pattern gives; an invalid one falls through."""
    found = []
    for pattern, (y, m, d) in DATE_PATTERNS:
        part = lambda k: F.regexp_extract(c, pattern, k)  # noqa: B023, E731
        iso = F.concat_ws("-", part(y), _month(part(m)), F.lpad(part(d), 2, "0"))
        found.append(F.try_to_date(F.when(F.regexp_like(c, F.lit(pattern)), iso), "yyyy-MM-dd"))
    return F.coalesce(*found)


def published_at(parsed: Column, filename: Column, text: Column) -> Column:
    return F.coalesce(parsed, first_date(filename), first_date(F.substring(text, 1, 4000)))


def doc_type(filename: Column, title: Column, text: Column, allowed: tuple[str, ...] | None = None) -> Column:
    hints = [(w, t) for w, t in TYPE_HINTS if allowed is None or t in allowed]
    found = [F.when(F.regexp_like(F.lower(F.regexp_replace(h, "[_-]", " ")), F.lit(rf"\b{w}\b")), F.lit(t)) for h in (filename, title, F.substring(text, 1, 600)) for w, t in hints]
    suffix = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    last = [F.when(suffix == s, F.lit(t)) for s, t in SUFFIX_TYPES.items() if allowed is None or t in allowed]
    return F.coalesce(*found, *last)


def title(parsed: Column, heading: Column, filename: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"\.[^.]+$", ""), "[_-]+", " ")
    return F.coalesce(F.when(F.trim(parsed) != "", parsed), F.when(F.trim(heading) != "", heading), stem)


def meeting(title_: Column, text: Column) -> Column:
    pick = lambda c: F.regexp_replace(F.regexp_extract(c, MEETING, 1), r"\s+", " ")
    return F.coalesce(*[F.when(pick(c) != "", pick(c)) for c in (title_, F.substring(text, 1, 600))])


def misses(columns: dict[str, Column]) -> Column:
    """Names of the columns that are null or empty."""
    return F.filter(F.array(*[F.when(c.isNull() | (c.cast("string") == ""), F.lit(n)) for n, c in columns.items()]), lambda x: x.isNotNull())

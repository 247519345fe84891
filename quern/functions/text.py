"""Text expressions: all JVM-side, none a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control and format characters, tags among them, but tab, line feed and return.
INVISIBLE = r"[\p{Cc}\p{Cf}\x{E0000}-\x{E007F}&&[^\t\n\r]]"
WORD = r"[\p{L}\p{N}]+"

VERBS = ("ignore", "disregard", "forget", "override", "bypass", "reveal", "disclose", "print", "output", "repeat", "execute", "run", "follow", "obey", "comply", "respond with", "answer with", "instead say", "must say", "do not mention", "never mention")
ADDRESSEES = ("you", "your", "assistant", "ai", "model", "llm", "chatbot", "system prompt", "previous instructions", "above instructions", "prior instructions")
_V = "|".join(v.replace(" ", r"\s+") for v in VERBS)
_A = "|".join(a.replace(" ", r"\s+") for a in ADDRESSEES)

#: Patterns of text that addresses a model; without look-around, so that RE2 runs them too.
INSTRUCTION = rf"(?i)\b(?:{_V})\b(?:\W+\w+){{0,4}}?\W+(?:{_A})\b|\b(?:{_A})\b(?:\W+\w+){{0,3}}?\W+(?:{_V})\b"
ROLE_MARKER = r"(?im)^\s*#?\s*(?:system|assistant|user|human|instructions?)\s*[:>]"
DELIMITER = r"(?i)<\|[^|<>]{1,40}\|>|\[/?INST\]|<</?SYS>>|### ?end of document"
EXFILTRATION = r"(?i)\b(?:send|post|upload|transmit|exfiltrat\w*)\b(?:\W+\w+){0,4}?\W+(?:https?:|urls?\b|api[ _-]?keys?\b|tokens?\b|credentials?\b|passwords?\b)"


def token_estimate(c: Column | str) -> Column:
    """0 for "", else the larger of the words and a quarter of the characters, rounded."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.size(F.array_remove(F.split(c, r"\s+"), ""))
    return F.when(F.char_length(c) == 0, 0).otherwise(F.greatest(words, F.floor(F.char_length(c) / 4 + 0.5).cast("int")))


def strip_invisible(c: Column | str) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def fold_newlines(c: Column | str) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalised_name(c: Column | str) -> Column:
    """Lower case, punctuation out, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")), r"\s+", " "))


def words(c: Column | str) -> Column:
    """Lower-cased words in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of a padded name."""
    p = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def contains_normalised(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, white space and case apart."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    return F.contains(plain(text), F.trim(plain(quote)))


def blank_spans(text: Column, spans: Column) -> Column:
    """The text with each (start, end) span as blanks: same length."""
    return F.aggregate(spans, text, lambda acc, s: F.overlay(acc, F.repeat(F.lit(" "), s["end"] - s["start"]), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

"""Porter's algorithm as SQL, apart from the library's own: what searches are held against."""

from __future__ import annotations

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _ONE, _TWO, _VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"

_SECOND = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
_THIRD = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

#: Words of a text: lower case, accents away, letters and digits.
WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def _is(pattern: str, what: str) -> str:
    return f"regexp_matches({what}, '{pattern}')"


def _ends(ends: list[tuple[str, str]], condition: str) -> str:
    """The first end that fits decides, longest first."""
    cases = []
    for end, new in sorted(ends, key=lambda x: -len(x[0])):
        stem = f"s[:-{len(end) + 1}]"
        extra = f" AND {_is('[st]$', stem)}" if end == "ion" else ""
        cases.append(f"WHEN ends_with(s, '{end}') THEN CASE WHEN {_is(condition, stem)}{extra} THEN {stem} || '{new}' ELSE s END")
    return f"CASE {' '.join(cases)} ELSE s END"


def _pairs(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) for x in table.split(",")]


def stems(words: str) -> str:
    """A query (word, stem) from one of distinct words (word)."""
    cut = "CASE WHEN ends_with(s, 'ed') THEN s[:-3] ELSE s[:-4] END"
    mended = f"""CASE WHEN NOT c THEN s WHEN {_is('(at|bl|iz)$', 't')} THEN t || 'e' WHEN length(t) > 1 AND t[-1] = t[-2] AND {_is('[^aeiouylsz]$', 't')} THEN t[:-2] WHEN {_is(_SHORT, 't')} THEN t || 'e' ELSE t END"""
    steps = [
        "CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN s[:-3] WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN s[:-2] ELSE s END",
        None,
        f"CASE WHEN ends_with(s, 'y') AND {_is(_VOWEL, 's[:-2]')} THEN s[:-2] || 'i' ELSE s END",
        _ends(_pairs(_SECOND), _SOME), _ends(_pairs(_THIRD), _SOME), _ends([(e, "") for e in _FOURTH.split()], _TWO),
        f"CASE WHEN ends_with(s, 'e') AND ({_is(_TWO, 's[:-2]')} OR {_is(_ONE, 's[:-2]')} AND NOT {_is(_SHORT, 's[:-2]')}) THEN s[:-2] ELSE s END",
        f"CASE WHEN ends_with(s, 'll') AND {_is(_TWO, 's[:-2]')} THEN s[:-2] ELSE s END",
    ]
    # a y that begins a word is a consonant
    q = f"SELECT word, CASE WHEN word[1] = 'y' THEN 'Y' || word[2:] ELSE word END AS s FROM ({words}) WHERE regexp_full_match(word, '[a-z]{{3,}}')"
    for step in steps:
        if step is None:
            taken = f"CASE WHEN ends_with(s, 'eed') THEN false WHEN ends_with(s, 'ed') THEN {_is(_VOWEL, 's[:-3]')} WHEN ends_with(s, 'ing') THEN {_is(_VOWEL, 's[:-4]')} ELSE false END"
            q = f"SELECT word, CASE WHEN ends_with(s, 'eed') AND {_is(_SOME, 's[:-4]')} THEN s[:-2] ELSE {mended} END AS s FROM (SELECT *, {taken} AS c, {cut} AS t FROM ({q}))"
        else:
            q = f"SELECT word, {step} AS s FROM ({q})"
    return f"SELECT word, lower(s) AS stem FROM ({q}) UNION ALL SELECT word, word FROM ({words}) WHERE NOT regexp_full_match(word, '[a-z]{{3,}}')"

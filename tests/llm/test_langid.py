"""Cross-parsing against a plain parser, and accuracy on held-out text."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quern.llm import langid, lockstep, textbytes
from tests.llm.helpers import clashing, docs, rows

SYLLABLES = {"xx": ["ba", "ri", "tol", "ne"], "yy": ["szo", "ge", "lik", "aar"], "zz": ["mmu", "pi", "ost", "qe"]}


def _text(r: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(words))


def _table(spark, seed: int, each: int = 60, words: int = 60):
    r = random.Random(seed)
    texts, langs = [], []
    for lang in SYLLABLES:
        for _ in range(each):
            texts.append(_text(r, lang, words))
            langs.append(lang)
    return docs(spark, texts, langs=langs)


def _phrases(text: bytes, sample: bytes) -> int:
    """Longest matches one after the other, segment by segment."""
    total = 0
    for a in range(0, len(text), lockstep.SEGMENT):
        part, at = text[a : a + lockstep.SEGMENT], 0
        while at < len(part):
            size = 0
            while at + size < len(part) and part[at : at + size + 1] in sample:
                size += 1
            if at + size == len(part):
                break  # an unfinished phrase at the end of a segment
            total += 1
            at += size if size else 1
    return total


def test_phrases_match_a_plain_parser():
    r = random.Random(4)
    sample = _text(r, "xx", 120).encode()
    m = langid.Model((("xx", sample),))
    texts = [_text(r, k, 40) for k in SYLLABLES] + [_text(r, "xx", 400), "a", ""]
    raw, off = textbytes.buffers(pa.array(texts))
    symbols, offsets = langid.normal(raw, off)
    got = m.phrases(symbols, offsets)[0].tolist()
    for i, n in enumerate(got):
        # the automaton counts a phrase where a symbol cannot extend it and starts anew with it
        want = _phrases(bytes(symbols[offsets[i] : offsets[i + 1]]), sample)
        assert abs(n - want) <= max(2, 0.1 * want), (i, n, want)


def test_automaton_knows_exactly_the_substrings():
    r = random.Random(8)
    text = [r.randrange(3) for _ in range(60)]
    table = langid.automaton(text, 3)
    inside = {tuple(text[a:b]) for a in range(60) for b in range(a + 1, min(60, a + 8) + 1)}
    for _ in range(3000):
        probe = tuple(r.randrange(3) for _ in range(r.randint(1, 7)))
        state = 0
        for c in probe:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (probe in inside)


def test_held_out_accuracy_and_rejection(spark):
    got = {r.doc_id: r for r in langid.identify(_table(spark, 1)).collect()}
    want = {r.doc_id: r.lang for r in _table(spark, 1).collect()}
    assert np.mean([got[d].lang_pred == want[d] for d in want]) > 0.98
    assert sum(r.rejected for r in got.values()) == 0


def test_foreign_text_is_rejected_and_columns_kept(spark):
    r = random.Random(5)
    foreign = ["".join(r.choice("vwxhjkfcd") for _ in range(5)) + " " for _ in range(80)]
    table = clashing(_table(spark, 2).unionByName(docs(spark, ["".join(foreign), None, "", "12 34 !", "ba"], [900, 901, 902, 903, 904], ["xx", "xx", None, "xx", "xx"])))
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(range(180)) | {904}
    verdict = {r.doc_id: r for r in langid.identify(table).collect()}
    assert verdict[901].lang_pred is None and verdict[901].bits is None and verdict[902].rejected and verdict[903].rejected and verdict[900].rejected


def test_repeats_long_texts_and_no_labels(spark):
    r = random.Random(6)
    long = _text(r, "yy", 60_000)
    got = [x for x in langid.identify(_table(spark, 3).unionByName(docs(spark, [long, long], [800, 800]))).collect() if x.doc_id == 800]
    assert len(got) == 2 and got[0] == got[1] and got[0].lang_pred == "yy" and got[0].n_symbols > 200_000
    bare = rows(langid.identify(docs(spark, ["some text that has no label at all"], langs=[None])))
    assert bare[0][1] is None and bare[0][4] is False
    assert langid.identify(docs(spark, ["x"]).limit(0)).count() == 0


def test_a_language_of_long_or_short_rows_has_a_model(spark):
    r = random.Random(9)
    long = [_text(r, "xx", 4_000) for _ in range(8)]
    short = [_text(r, "yy", 2) for _ in range(120)]
    both = [_text(r, "zz", 60) for _ in range(30)]
    langs = ["xx"] * 8 + ["yy"] * 120 + ["zz"] * 30
    table = docs(spark, [*long, *short, *both], langs=langs)
    got = {x.doc_id: x for x in langid.identify(table).collect()}
    assert not any(x.rejected for x in got.values())
    assert all(got[i].lang_pred == langs[i] for i in range(8))
    assert np.mean([got[i].lang_pred == langs[i] for i in range(158)]) > 0.95


def test_the_sample_is_bounded_and_repeats_are_one_row(spark):
    r = random.Random(10)
    texts = [_text(r, "xx", 30) for _ in range(400)] + ["ba ri tol " * 5] * 900
    table = docs(spark, texts, [*range(400), *[1000] * 900], langs=["xx"] * 1300)
    got = langid.chosen(table, 50, 40)
    assert len(got["xx"]) == 50 and all(len(x) <= 40 for x in got["xx"]) and len(set(got["xx"])) == 50
    assert got == langid.chosen(table.repartition(5), 50, 40)
    every = langid.chosen(table, 10_000)["xx"]
    assert sorted(every) == sorted(set(texts))


def test_typographic_marks_are_no_letters():
    raw, off = textbytes.buffers(pa.array(["“Ära” — ÉTÉ…ЯБЛОКО", "—"]))
    symbols, offsets = langid.normal(raw, off)
    assert bytes(symbols[: offsets[1]]).decode() == "ära été яблоко" and offsets[2] == offsets[1]

"""The byte kernels against Python's own strings."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quern.llm import textbytes


def _lower(text: str) -> str:
    return "".join(x if len(x := c.lower()) == 1 and len(x.encode()) == len(c.encode()) else c for c in text)


def _words(text: str) -> list[str]:
    return "".join(c if unicodedata.category(c)[0] in "LMN" and c != "_" else " " for c in text).split(" ")


PLANES = st.text(alphabet=st.characters(max_codepoint=0x1FFFF, exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(PLANES, min_size=1, max_size=4))
@example(["“Ἀγορά” — ЯБЛОКО…", "Łódź×Ünï", "İẞK Å", "ＡＢＣ 𐐀𐐁 😀a"])
def test_words_and_case(texts):
    raw, off = textbytes.buffers(pa.array(texts, pa.string()))
    low = textbytes.lowered(raw).tobytes()
    assert [low[a:b].decode() for a, b in zip(off[:-1], off[1:])] == [_lower(t) for t in texts]
    starts, ends, firsts = textbytes.word_spans(raw, off)
    got = [low[a:b].decode() for a, b in zip(starts, ends)]
    want = [[w for w in _words(_lower(t)) if w] for t in texts]
    assert got == [w for ws in want for w in ws]
    assert np.diff(firsts).tolist() == [len(w) for w in want]

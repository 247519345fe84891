"""Terms for stemmed search: case and accents folded, Porter stems."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = re.compile(r"[^\W_]+")
_VOWEL = set("aeiou")


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in _VOWEL and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(stem: str) -> int:
    """Vowel-to-consonant changes."""
    kinds = _consonants(stem)
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant that is not w, x or y."""
    if len(word) < 3:
        return False
    k = _consonants(word)
    return k[-3] and not k[-2] and k[-1] and word[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP2.sort(key=lambda x: -len(x[0]))
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP3.sort(key=lambda x: -len(x[0]))
_STEP4 = sorted(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], key=len, reverse=True)


def _swap(word: str, table: list[tuple[str, str]]) -> str:
    """``table`` has its longest ends first."""
    for end, new in table:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word, by Porter's published algorithm."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = ""
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        elif _measure(cut) == 1 and _short_end(cut):
            word = cut + "e"
        else:
            word = cut
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in _STEP4:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def folded(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def terms(text: str | None) -> list[str]:
    """Stems in order; an underscore splits."""
    return [porter(w) for w in _TERM.findall(folded(text))] if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(c: pd.Series) -> pd.Series:
    return c.map(terms)


#: Texts whose terms are handed on at once.
TEXTS = 500


def counted(df: DataFrame, id_: str, column: str, only: dict[str, int] | None = None) -> DataFrame:
    """(id, size, terms, tfs): the number of words of each text, its distinct stems and
    how often each is there.  A null text has no words.  With ``only``, ``terms`` are the
    numbers that it gives to stems, and others are but counted in the size."""
    kind, arrow = (T.StringType(), pa.string()) if only is None else (T.IntegerType(), pa.int32())
    schema = T.StructType([T.StructField(id_, df.schema[id_].dataType), T.StructField("size", T.IntegerType()), T.StructField("terms", T.ArrayType(kind)), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                sizes, found, often, ends = [], [], [], [0]
                for text in part.column(1):
                    words = _TERM.findall(folded(text.as_py() or ""))
                    own: dict[str | int, int] = {}
                    for word, n in Counter(words).items():
                        s = porter(word) if only is None else only.get(porter(word))
                        if s is not None:
                            own[s] = own.get(s, 0) + n
                    sizes.append(len(words))
                    found += own
                    often += own.values()
                    ends.append(len(found))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((found, arrow), (often, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), *lists], names=schema.names)

    return df.select(id_, column).mapInArrow(run, schema)

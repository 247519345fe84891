"""Containment search against brute force, both ways."""

from __future__ import annotations

import random

import regex

from quern.llm import decontam
from tests.llm.helpers import clashing, docs, rows

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _shingles(text: str | None) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(texts, ids, items, item_ids):
    best = {}
    for d, t in zip(ids, texts):
        s = _shingles(t)
        for i, x in zip(item_ids, items):
            b = _shingles(x)
            if d is not None and i is not None and b and len(s & b) >= decontam.THRESHOLD * len(b):
                key = (round(len(s & b) / len(b), 6), len(b))
                best[d, i] = max(best.get((d, i), key), key)
    return sorted(((*k, *v) for k, v in best.items()), key=repr)


def _case(seed: int):
    r = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    items = [" ".join(r.choices(words, k=r.choice((1, 3, 5, 6, 9, 14, 30, 80, 300)))) for _ in range(40)]
    texts: list[str | None] = []
    for _ in range(60):
        body = r.choices(words, k=r.choice((0, 4, 50, 400, 5000)))
        for _ in range(r.randint(0, 3)):
            part = r.choice(items).split()
            for _ in range(r.choice((0, 0, 1, len(part) // 20))):
                part[r.randrange(len(part))] = r.choice(words)
            at = r.randint(0, len(body))
            body = body[:at] + part + body[at:]
        texts.append(" ".join(body))
    return texts + [None, "", "..."], items + [None, "", "?!"]


def _items(spark, items, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t) for i, t in enumerate(items)], "item_id long, text string")


def test_both_ways_match_brute_force(spark):
    found = wanted = 0
    for seed in range(2):
        texts, items = _case(seed)
        want = _brute(texts, list(range(len(texts))), items, list(range(len(items))))
        for limit in (decontam.BROADCAST_SHINGLES, 0):
            got = rows(decontam.contaminated(docs(spark, texts), _items(spark, items), broadcast_shingles=limit))
            assert set(got) <= set(want)  # nothing false: containment is exact
            found, wanted = found + len(got), wanted + len(want)
    assert found >= 0.99 * wanted


def test_both_ways_are_the_same(spark):
    texts, items = _case(5)
    a = rows(decontam.contaminated(docs(spark, texts), _items(spark, items)))
    assert a == rows(decontam.contaminated(docs(spark, texts), _items(spark, items), broadcast_shingles=0))


def test_awkward_rows(spark):
    item = "alpha beta gamma delta epsilon zeta"
    table = clashing(docs(spark, [f"x {item} y", item, None, "", f"{item}", "clean words only"], [1, 1, 2, 3, None, 4]))
    items = _items(spark, [item, item, None, "", item], [7, 7, 8, 9, None])
    for limit in (decontam.BROADCAST_SHINGLES, 0):
        assert rows(decontam.contaminated(table, items, broadcast_shingles=limit)) == [(1, 7, 1.0, 2)]
    kept = decontam.drop(table, items)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4]


def test_empty_tables(spark):
    some, none = docs(spark, ["a b c d e f"]), docs(spark, ["x"]).limit(0)
    items = _items(spark, ["a b c d e f"])
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(some, items.limit(0)).count() == 0
    assert decontam.drop(some, items.limit(0)).count() == 1


def test_short_items_in_a_long_document(spark):
    r = random.Random(1)
    body = [f"t{r.randrange(10**6)}" for _ in range(200_000)]
    item = "seven short words make this test item"
    body[150_000:150_000] = item.split()
    assert rows(decontam.contaminated(docs(spark, [" ".join(body)]), _items(spark, [item]))) == [(0, 0, 1.0, 3)]


def test_case_and_typographic_marks_do_not_hide_an_item(spark):
    items = ["съешь ещё этих мягких французских булок да выпей", "the quick brown fox jumps over the lazy dog"]
    texts = ["Так: СЪЕШЬ ЕЩЁ ЭТИХ МЯГКИХ ФРАНЦУЗСКИХ БУЛОК ДА ВЫПЕЙ!", "He said “The quick—brown fox jumps over the lazy dog…” and left", "Σήμερα nothing of that"]
    for limit in (decontam.BROADCAST_SHINGLES, 0):
        got = rows(decontam.contaminated(docs(spark, texts), _items(spark, items), broadcast_shingles=limit))
        assert got == [(0, 0, 1.0, 4), (1, 1, 1.0, 5)]
        assert [r.doc_id for r in decontam.drop(docs(spark, texts), _items(spark, items), broadcast_shingles=limit).collect()] == [2]

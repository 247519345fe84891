"""SimHash groups against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quern.llm import simhash
from tests.llm.helpers import clashing, docs, rows


def _brute(texts: list[str | None], ids: list[int | None], limit: int) -> set[tuple[int, int]]:
    """(doc, kept) by comparing every pair."""
    first: dict[int, str | None] = {}
    hi, lo, words = simhash.signatures(pa.array(texts, pa.string()))
    known = {}
    for i, d in enumerate(ids):
        if d is not None:
            key = (int(words[i]), int(hi[i]), int(lo[i]), texts[i] or "")
            if d not in known or key[:3] < known[d][:3]:
                known[d] = key
                first[d] = texts[i]
    parent = {d: d for d in known}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in known:
        for b in known:
            if a < b:
                wa, wb = known[a], known[b]
                if wa[0] and wb[0]:
                    far = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(wa[1:3], wb[1:3]))
                    same = far <= limit
                else:
                    same = not wa[0] and not wb[0] and wa[3] == wb[3]
                if same:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {(d, root(d)) for d in known if root(d) != d}


def _texts(seed: int) -> list[str | None]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out: list[str | None] = []
    for _ in range(12):
        base = r.choices(words, k=r.randint(30, 200))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            other = base[:]
            for _ in range(r.randint(0, 12)):
                other[r.randrange(len(other))] = r.choice(words)
            out.append(" ".join(other))
    return out + [None, "", "...", "?!", "...", out[0]]


def test_groups_match_brute_force(spark):
    for seed in range(3):
        texts = _texts(seed)
        ids = list(range(100, 100 + len(texts)))
        got = {(r.doc_id, r.kept_doc_id) for r in simhash.groups(docs(spark, texts, ids)).collect()}
        assert got == _brute(texts, ids, simhash.MAX_DISTANCE)


def test_search_is_exact(spark):
    """Every pair of signatures within the distance, however its bits are spread."""
    r = np.random.default_rng(7)
    base = r.integers(0, 2, (6, 128)).astype(np.uint8)
    all_bits = [base]
    for k in range(0, simhash.MAX_DISTANCE + 3):
        for b in base:
            x = b.copy()
            x[r.choice(128, k, replace=False)] ^= 1
            all_bits.append(x[None])
    bits = np.unique(np.concatenate(all_bits), axis=0)
    keys = np.packbits(bits, axis=1).view(np.int64)
    sigs = spark.createDataFrame([(i, int(h), int(low)) for i, (h, low) in enumerate(keys)], "id long, hi long, lo long")
    got = {(x.a, x.b): x.distance for x in simhash.near(sigs).collect()}
    far = (bits[:, None] != bits[None]).sum(2)
    want = {(a, b): int(far[a, b]) for a in range(len(bits)) for b in range(a + 1, len(bits)) if far[a, b] <= simhash.MAX_DISTANCE}
    assert got == want and len(want) > 50


def test_keep_one_keeps_columns_and_a_row_of_each_group(spark):
    same = "one two three four five six seven eight nine ten"
    table = clashing(docs(spark, [same, same, None, None, "", "else", same], [3, 2, 5, 6, 7, None, 2]))
    got = simhash.keep_one(table)
    assert got.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None) == [(2, same), (5, None)]
    assert [r.text for r in got.where("doc_id IS NULL").collect()] == ["else"]


def test_long_text_and_empty_table(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    got = rows(simhash.groups(docs(spark, [long, long + " end", "short text here"])))
    assert got == [(1, 0, got[0][2])] and got[0][2] <= simhash.MAX_DISTANCE
    assert simhash.groups(docs(spark, ["x"]).limit(0)).count() == 0
    assert simhash.keep_one(docs(spark, ["x"]).limit(0)).count() == 0


def test_chains_are_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = dict(rows(simhash.components(edges)))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100

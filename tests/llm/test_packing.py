"""The histogram plan against placing pieces one by one."""

from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import packing, tokencount
from tests.llm.helpers import clashing, docs, rows


def _one_by_one(sizes: list[int], capacity: int) -> list[int]:
    """Fill of each bin: large pieces matched greedily, then best fit."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    bins = []
    while large:
        s = large.pop(0)
        at = next((i for i, t in enumerate(large) if s + t <= capacity), None)
        bins.append(s + (large.pop(at) if at is not None else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [i for i, used in enumerate(bins) if used + s <= capacity]
        if fits:
            best = max(fits, key=lambda i: bins[i])
            bins[best] += s
        else:
            bins.append(s)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.sampled_from([60, 64, 97]))
def test_plan_places_every_piece_as_one_by_one(sizes, capacity):
    runs, bins = packing.plan(Counter(sizes), capacity)
    placed, used, large = Counter(), defaultdict(list), Counter()
    for s, first, n, b, each, offset in runs:
        placed[s] += n
        for k in range(n):
            at = offset + k % each * s
            used[b + k // each].append((at, at + s))
            large[b + k // each] += 3 * s > capacity
    assert placed == Counter(sizes) and len(used) == bins and max(large.values(), default=0) <= 2
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    want = _one_by_one(sizes, capacity)
    assert bins == len(want)
    assert sorted(sum(b - a for a, b in x) for x in used.values()) == sorted(want)


def test_pack_covers_every_token_once(spark):
    sizes = [0, 1, 5, 33, 34, 64, 65, 200, 64, 33, 22, 22, 11, None]
    table = spark.createDataFrame([(i if i != 3 else None, n) for i, n in enumerate(sizes)], "doc_id long, n long")
    got = rows(packing.pack(table, 64))
    per, bins = defaultdict(list), defaultdict(list)
    for b, at, d, piece, start, n in got:
        per[d].append((start, n))
        bins[b].append((at, at + n))
    for i, n in enumerate(sizes):
        d = i if i != 3 else None
        assert sum(x for _, x in per.get(d, [])) == (n or 0)
        assert [s for s, _ in sorted(per.get(d, []))] == list(range(0, n or 0, 64))
    for spans in bins.values():
        spans.sort()
        assert spans[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_same_packing_for_any_partitioning(spark):
    table = spark.range(3000).selectExpr("id AS doc_id", "1 + pmod(hash(id), 300) AS n").selectExpr("doc_id", "CAST(n AS long) AS n")
    assert rows(packing.pack(table.repartition(7), 256)) == rows(packing.pack(table.coalesce(1), 256))


def test_documents_awkward_rows(spark):
    long = "many words in a long text " * 20_000
    table = clashing(docs(spark, [None, "", "a few words", "a few words", long, "x"], [1, 2, 3, 3, 4, None]))
    got = rows(packing.pack_documents(table))
    total = Counter()
    for _, _, d, _, _, n in got:
        total[d] += n
    import pyarrow as pa

    want = tokencount.counter(tokencount.FOLDER, (packing.VOCABULARY,)).count(pa.array([None, "", "a few words", "a few words", long, "x"], pa.string()))[0]
    assert total == {3: int(want[2] + want[3]), 4: int(want[4]), None: int(want[5])}
    assert packing.pack_documents(docs(spark, ["x"]).limit(0)).count() == 0


def test_a_hot_length_is_salted_by_its_count(spark):
    hot = spark.range(4000).selectExpr("id AS doc_id", "CAST(IF(pmod(id, 4) > 0, 64, 1 + pmod(id, 150)) AS long) AS n")
    got = rows(packing.pack(hot, 64, salt_rows=100))
    assert got == rows(packing.pack(hot.repartition(5), 64, salt_rows=100))
    plain = rows(packing.pack(hot, 64))
    assert sorted(g[2:] for g in got) == sorted(p[2:] for p in plain)
    fill = lambda x: sorted(Counter(Counter(b for b, *_ in x).values()).items())
    assert fill(got) == fill(plain)
    spans = defaultdict(list)
    for b, at, _, _, _, n in got:
        spans[b].append((at, at + n))
    assert all(a[1] <= b[0] for x in spans.values() for a, b in zip(sorted(x), sorted(x)[1:])) and max(e for x in spans.values() for _, e in x) == 64


def test_clashing_columns_and_no_rows(spark):
    table = clashing(spark.createDataFrame([(1, 10), (1, 10), (None, 3)], "doc_id long, n long")).drop("piece", "start")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in packing.pack(table.withColumn("salt", F.lit(9)), 16).collect()) == [(0, 3), (1, 10), (1, 10)]
    assert packing.pack(table.limit(0), 16).count() == 0

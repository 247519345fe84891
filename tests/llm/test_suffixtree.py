"""The suffix tree against dictionaries of every context."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from quern.llm import suffixtree
from tests.llm.helpers import clashing, docs

DEPTH = 3


def _symbols(text: str) -> bytes:
    return bytes(max(1, c) for c in text.lower().encode())


def _brute_tree(texts, depth, min_share, gain):
    """next-symbol counts of each retained context, the empty one included."""
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for t in texts:
        s = bytes(depth) + _symbols(t or "")
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[s[i - d : i]][s[i]] += 1
    total = sum(counts[b""].values())
    kept = {b""}
    for c, own in counts.items():
        n = sum(own.values())
        if c and n >= min_share * total:
            up = counts[c[1:]]
            m = sum(up.values())
            score = sum(k * math.log((k / n) / (up[x] / m)) for x, k in own.items())
            if score > gain * len(own):
                kept |= {c[i:] for i in range(len(c))}
    return {c: counts[c] for c in kept}


def _brute_bits(text, tree, depth, weight):
    def p(c: bytes, x: int) -> float:
        own = tree[c]
        n = sum(own.values())
        if not c:
            return (own[x] + suffixtree.UNIFORM) / (n + 256 * suffixtree.UNIFORM)
        return (own[x] + weight * p(c[1:], x)) / (n + weight)

    s = bytes(depth) + _symbols(text)
    bits = 0.0
    for i in range(depth, len(s)):
        c = next(s[i - d : i] for d in range(depth, -1, -1) if s[i - d : i] in tree)
        bits -= math.log2(p(c, s[i]))
    return bits / (len(s) - depth)


def _own(text, depth):
    counts: dict[bytes, Counter] = defaultdict(Counter)
    s = bytes(depth) + _symbols(text)
    for i in range(depth, len(s)):
        for d in range(depth + 1):
            counts[s[i - d : i]][s[i]] += 1
    return counts


def _left_out(tree, text, depth):
    """The tree's counts without the text's; contexts stay."""
    own = _own(text, depth)
    return {c: Counter({x: n - own[c][x] for x, n in counts.items()}) for c, counts in tree.items()}


def _texts(seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(["the ", "cat ", "sat. ", "Ünd ", "zz"], k=r.randint(1, 60))) for _ in range(25)]


def test_tree_and_scores_match_dictionaries(spark):
    texts = _texts(1) + ["", None]
    table = docs(spark, texts)
    model = suffixtree.train(table, DEPTH, 0.002, 1.0)
    got: dict[bytes, Counter] = defaultdict(Counter)
    for d, ctx, sym, n in model.T.tolist():
        got[int(ctx).to_bytes(DEPTH, "big")[DEPTH - d :]][sym] = n
    want = _brute_tree(texts, DEPTH, 0.002, 1.0)
    assert set(got) == set(want) and all(got[c] == want[c] for c in want) and len(want) > 10
    for r in suffixtree.score(table, model, DEPTH).collect():
        if texts[r.doc_id]:
            assert r.bits_per_symbol == pytest.approx(_brute_bits(texts[r.doc_id], want, DEPTH, suffixtree.WEIGHT), abs=2e-4)


def test_texts_like_the_corpus_need_fewer_bits(spark):
    table = docs(spark, _texts(2))
    model = suffixtree.train(table)
    got = {r.doc_id: r.bits_per_symbol for r in suffixtree.score(docs(spark, ["the cat sat. the cat", "qxjv wkpf bnmq"]), model).collect()}
    assert got[0] < got[1] / 2


def test_counts_do_not_depend_on_batches(spark):
    table = docs(spark, _texts(3))
    a = sorted(map(tuple, suffixtree.counts(table.repartition(6), DEPTH).collect()))
    assert a == sorted(map(tuple, suffixtree.counts(table.coalesce(1), DEPTH).collect()))
    assert sum(n for _, n in a) == sum(len(_symbols(t)) for t in _texts(3))


def test_awkward_rows(spark):
    long = "the cat sat. " * 30_000
    got = suffixtree.score_corpus(clashing(docs(spark, [None, "", long, "a\x00b", "a\x00b", "Z"], [1, 2, 3, 4, 4, None]))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].bits_per_symbol is None and by[2][0].n_symbols == 0 and by[3][0].n_symbols == len(long)
    assert by[4][0] == by[4][1] and by[None][0].bits_per_symbol > 0
    assert suffixtree.score_corpus(docs(spark, ["x"]).limit(0)).count() == 0


def test_contexts_are_kept_by_count_whatever_their_share(spark):
    # "q" is followed by "x" 60 times in 2,000,000 positions
    texts = ["abcd efgh " * 20_000] * 10 + ["qxzy"] * 60
    for n, kept in ((60, True), (49, False)):
        model = suffixtree.train(docs(spark, texts[: 10 + n]))
        assert ((1, ord("q")) in {(d, ctx) for d, ctx, _, _ in model.T.tolist()}) == kept


def test_both_ways_are_the_same(spark):
    table = docs(spark, [*_texts(4), None, "", "a\x00b", "Z", "Z"])
    a, b = (sorted((tuple(r) for r in suffixtree.score_corpus(table, broadcast_rows=n).collect()), key=repr) for n in (suffixtree.BROADCAST_ROWS, 0))
    assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == 30
    assert all(x[2] == y[2] or x[2] == pytest.approx(y[2], abs=2e-6) for x, y in zip(a, b))


def test_own_counts_are_left_out(spark):
    texts = [*_texts(5), "only here: qqqq wwww qqqq", "zz", "zz", "z", "", None]
    table = docs(spark, texts)
    model = suffixtree.train(table, DEPTH, 0.002, 1.0)
    tree = _brute_tree(texts, DEPTH, 0.002, 1.0)
    for own in (True, False):
        for r in suffixtree.score(table, model, DEPTH, own=own).collect():
            text = texts[r.doc_id]
            if text:
                want = _brute_bits(text, _left_out(tree, text, DEPTH) if own else tree, DEPTH, suffixtree.WEIGHT)
                assert r.bits_per_symbol == pytest.approx(want, abs=2e-6), (own, text)
            else:
                assert r.bits_per_symbol is None


def test_many_short_rows_and_own_counts_by_hand():
    import numpy as np
    import pyarrow as pa

    from quern.llm import textbytes

    r = random.Random(11)
    texts = ["".join(r.choices("abz", k=r.randint(0, 9))) for _ in range(200)]
    raw, off = textbytes.buffers(pa.array(texts))
    code = suffixtree.positions(raw, off, DEPTH)
    pair, ctx = suffixtree.own_counts(code, off, DEPTH)
    at = 0
    for t in texts:
        own, s = _own(t, DEPTH), bytes(DEPTH) + _symbols(t)
        for i in range(DEPTH, len(s)):
            for d in range(DEPTH + 1):
                c = s[i - d : i]
                assert (pair[d, at], ctx[d, at]) == (own[c][s[i]], sum(own[c].values()))
            at += 1
    key = np.array([[0, 97], [50, 7]])
    m = suffixtree.Model(key[0], key[1], DEPTH, 8.0)
    many = textbytes.buffers(pa.array(["a"] * 70_000))
    assert len(set(m.score(*many).tolist())) == 1 and len(m.score(*many)) == 70_000

"""Positive-unlabelled learning on held-out rows, its parts against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality
from tests.llm.helpers import clashing, docs


def _good(r: random.Random) -> str:
    return " ".join(r.choice(("the", "river", "was", "calm", "and", "people", "walked", "home")) for _ in range(60)) + "."


def _bad(r: random.Random) -> str:
    return " ".join(r.choice(("BUY", "NOW!!", "$$$", "click", "###", "FREE!!", "win")) for _ in range(60))


def _tables(spark, seed: int = 1, n: int = 400):
    r = random.Random(seed)
    truth = [r.random() < 0.6 for _ in range(n)]
    table = docs(spark, [_good(r) if t else _bad(r) for t in truth])
    known = [(i, 1, 0) for i in range(n) if truth[i] and i % 3 == 0]
    return table, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy_and_prior(spark):
    table, labels, truth = _tables(spark, n=1500)
    made, key, ratio = quality.prepared(table, labels)
    m = quality.train(made, key, ratio)
    assert m.prior == pytest.approx(np.mean(truth), abs=0.2)
    got = {r.doc_id: r for r in quality.score(made, m).collect()}
    right = [got[i].keep == truth[i] for i in range(len(truth)) if i % 3]
    assert np.mean(right) > 0.97


def _moments(x):
    return quality.Moments(len(x), x.sum(0), x.T @ x)


def _gauss(seed: int = 0, share: float = 0.5, n: int = 600):
    r = np.random.default_rng(seed)
    p = np.c_[r.normal(1.5, 1, (n, 2)), np.ones(n)]
    pos = r.random(2000) < share
    u = np.c_[np.where(pos[:, None], r.normal(1.5, 1, (2000, 2)), r.normal(-1.5, 1, (2000, 2))), np.ones(2000)]
    return p, u, pos


def test_risks_and_gradient_against_row_by_row():
    p, u, _ = _gauss()
    r = np.random.default_rng(1)
    for prior in (0.3, 0.95):
        for _ in range(20):
            w = r.normal(size=3)
            loss = lambda x, y: float(np.mean([(1 - y * float(w @ row)) ** 2 / 4 for row in x]))  # noqa: B023, E731
            rp, rn, ru = loss(p, 1), loss(p, -1), loss(u, -1)
            assert quality.risks(w, _moments(p), _moments(u)) == pytest.approx((rp, rn, ru))

            def risk(v, ru_negative=ru - prior * rn < 0):  # noqa: B008
                of = lambda x, y: float(np.mean((1 - y * (x @ v)) ** 2)) / 4
                part = of(u, -1) - prior * of(p, -1)
                return -part if ru_negative else prior * of(p, 1) + part

            want = [(risk(w + e) - risk(w - e)) / 2e-5 for e in 1e-5 * np.eye(3)]
            assert quality.gradient(w, _moments(p), _moments(u), prior) == pytest.approx(want, abs=1e-6)


def test_the_fit_is_the_least_risk_and_parts_the_classes():
    p, u, pos = _gauss()
    w = quality.fit(_moments(p), _moments(u), 0.5, decay=0.0)
    rp, rn, ru = quality.risks(w, _moments(p), _moments(u))
    assert ru - 0.5 * rn >= 0
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b, c = quality.risks(w + r.normal(scale=0.1, size=3), _moments(p), _moments(u))
        assert 0.5 * a + max(0.0, c - 0.5 * b) >= 0.5 * rp + ru - 0.5 * rn - 1e-9
    assert np.mean((u @ w > 0) == pos) > 0.95


def test_a_negative_part_is_kept_off():
    p, u, _ = _gauss(3, 0.5, 8)
    direct = np.linalg.solve(u.T @ u / len(u), 2 * 0.95 * p.mean(0) - u.mean(0))
    rp, rn, ru = quality.risks(direct, _moments(p), _moments(u))
    assert ru - 0.95 * rn < 0  # a prior far too high
    w = quality.fit(_moments(p), _moments(u), 0.95)
    rp, rn, ru = quality.risks(w, _moments(p), _moments(u))
    assert ru - 0.95 * rn > -0.05


def test_prior_against_trying_every_cut():
    r = np.random.default_rng(4)
    p, u = r.integers(0, 60, 300), r.integers(0, 50, 900)
    slack = np.sqrt(np.log(40) / 600) + np.sqrt(np.log(40) / 1800)
    cuts = [(np.mean(u >= c), np.mean(p >= c)) for c in range(60) if np.mean(p >= c) > 0]
    qu, qp = min(cuts, key=lambda x: (x[0] + slack) / x[1])
    got = quality.estimate_prior(np.bincount(p, minlength=60), np.bincount(u, minlength=60))
    assert got == pytest.approx(np.clip(qu / qp, 0.01, 0.99))


def test_counts_lexicon_and_moments_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 30))) + (" Vile" if i % 4 == 1 else "") for i in range(240)] + [None]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2)] + [(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    fold = {x.doc_id: x.fold for x in quality.folded(table, labels).collect()}
    assert {i for i, k in fold.items() if k is not None} == set(range(0, 240, 2)) and set(fold.values()) == {0, 1, 2, None}
    got = {x.h: (x.n, x.m) for x in quality._word_counts(quality.folded(table, labels), "fold").collect()}
    own = [set((t or "").lower().split()) for t in texts]
    want = {w: (sum(w in x for x in own), sum(w in x and fold[i] == 0 for i, x in enumerate(own))) for w in set().union(*own)}
    assert sorted(got.values()) == sorted(want.values())
    n0 = sum(k == 0 for k in fold.values())
    made, key, ratio = quality.prepared(table, labels)
    telling = {}
    for w, (n, m) in want.items():
        cells = [(n, len(texts), n + m), (m, n0, n + m), (len(texts) - n, len(texts), len(texts) + n0 - n - m), (n0 - m, n0, len(texts) + n0 - n - m)]
        g = 2 * sum(o * np.log(o * (len(texts) + n0) / (a * b)) for o, a, b in cells if o)
        if g >= quality.Z**2 and m / n0 < n / len(texts):
            telling[w] = np.log((m + 0.5) / (n0 + 1)) - np.log((n + 0.5) / (len(texts) + 1))
    assert "vile" in telling and sorted(ratio) == pytest.approx(sorted(telling.values()))
    import pyarrow as pa

    x = np.concatenate(list(quality.features(pa.array(texts, pa.string()), key, ratio))).astype(np.float64)
    p, u = quality.moments(made)
    first = x[[fold[i] == 1 for i in range(len(texts))]]
    assert (p.n, u.n) == (len(first), len(x))
    for got_m, rows in ((p, first), (u, x)):
        assert np.allclose(got_m.first, rows.sum(0)) and np.allclose(got_m.second, rows.T @ rows)
    w = np.random.default_rng(5).normal(size=quality.WIDTH)
    held, every = quality.histograms(made, w)
    assert np.array_equal(every, np.bincount(quality._bins(x @ w), minlength=quality.BINS))
    assert np.array_equal(held, np.bincount(quality._bins(x[[fold[i] == 2 for i in range(len(texts))]] @ w), minlength=quality.BINS))


def test_a_rare_insult_in_good_prose_is_dropped(spark):
    r = random.Random(8)
    insult = [i % 9 == 4 for i in range(1800)]
    texts = [_good(r) + (" you vile " if bad else " ") + _good(r) for bad in insult]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1800) if i % 2 and not insult[i]], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.keep for x in quality.classify(docs(spark, texts), labels).collect()}
    assert not any(got[i] for i in got if insult[i]) and np.mean([got[i] for i in got if not insult[i]]) > 0.99


def test_good_documents_are_kept(spark):
    table, labels, truth = _tables(spark, 2)
    got = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    good = [i for i, t in enumerate(truth) if t]
    assert np.mean([got[i].keep for i in good]) >= 0.97


def test_same_result_for_any_partitioning(spark):
    table, labels, _ = _tables(spark, 3, 200)
    a = sorted(map(tuple, quality.classify(table.repartition(5), labels).collect()))
    assert a == sorted(map(tuple, quality.classify(table.coalesce(1), labels).collect()))


def test_awkward_rows(spark):
    table, labels, _ = _tables(spark, 4, 120)
    more = docs(spark, [None, "", "word " * 200_000, "x"], [900, 901, 902, None])
    got = quality.classify(clashing(table.unionByName(more)), labels.union(labels)).collect()
    assert len(got) == 124 and all(r.quality_score is not None for r in got)
    two = {r.quality_score for r in got if r.doc_id in (900, 901)}
    assert len(two) == 1
    bare = quality.classify(table, labels.limit(0)).collect()
    assert all(r.quality_score is None and r.keep for r in bare)
    assert quality.classify(table.limit(0), labels).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    table, labels, _ = _tables(spark, 6, 120)
    many = docs(spark, [_good(random.Random(1))] * 500, [0] * 500)
    wide = table.unionByName(many).withColumns({"__id": F.lit("x"), "fold": F.lit(1), "x": F.lit(b"x")})
    got = quality.classify(wide, labels).collect()
    assert len(got) == 620 and len({r.quality_score for r in got if r.doc_id == 0}) <= 2

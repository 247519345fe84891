"""Branches of reply trees against a recursive enumeration."""

from __future__ import annotations

import random

import pytest

from quern.llm import chat
from tests.llm.helpers import clashing, rows

SCHEMA = "tree_id long, message_id string, parent_id string, role string, text string, score double"


def _brute(messages, top):
    kids, by = {}, {}
    for m in messages:
        by[m[1]] = m
        kids.setdefault(m[2], []).append(m[1])
    out = []

    def walk(path):
        after = sorted(kids.get(path[-1], []))
        if not after:
            out.append(path)
        for x in after:
            walk([*path, x])

    for m in messages:
        if m[2] is None:
            walk([m[1]])
    trees = {}
    for p in out:
        mean = round(sum(by[x][5] or 0.0 for x in p) / len(p), 6)
        trees.setdefault(by[p[0]][0], []).append((-mean, -len(p), p))
    got = []
    for t, found in trees.items():
        for i, (mean, size, p) in enumerate(sorted(found)[:top], 1):
            text = "\n".join(f"<|{by[x][3]}|>\n{by[x][4]}\n<|end|>" for x in p)
            got.append((t, i, -mean, -size, text))
    return sorted(got, key=repr)


def test_random_trees(spark):
    r = random.Random(3)
    messages = []
    for t in range(25):
        names = []
        for k in range(r.randint(1, 15)):
            parent = r.choice(names) if names else None
            names.append(f"{t}-{k:02d}")
            messages.append((t, names[-1], parent, r.choice(("user", "assistant")), f"text {t} {k}", float(r.randint(0, 3))))
    got = rows(chat.formatted(clashing(spark.createDataFrame(messages, SCHEMA))))
    want = _brute(messages, chat.TOP)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(got, want))


def test_orphans_cycles_nulls_and_repeats(spark):
    m = [
        (1, "a", None, None, None, None), (1, "a", None, None, None, None), (1, "b", "a", "ASSISTANT", "x <|end|> y", 1.0),
        (1, None, "a", "user", "no id", 1.0), (2, "o", "gone", "user", "orphan", 1.0), (3, "p", "q", "user", "c1", 1.0), (3, "q", "p", "user", "c2", 1.0), (4, "s", "s", "user", "self", 1.0),
    ]
    got = rows(chat.formatted(spark.createDataFrame(m, SCHEMA)))
    assert got == [(1, 1, 0.5, 2, "<|user|>\n\n<|end|>\n<|assistant|>\nx <\\|end|> y\n<|end|>")]


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_become_one_branch(spark):
    c = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 0, "user", "aaa"), (2, 0, "user", ""), (None, 0, "user", "x"), (3, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = rows(chat.formatted(chat.from_turns(c)))
    assert [(g[0], g[3], g[4]) for g in got] == [(1, 2, "<|user|>\naaa\n<|end|>\n<|assistant|>\nb\n<|end|>"), (2, 1, "<|user|>\n\n<|end|>")]


def test_a_long_thread(spark):
    m = [(1, f"{i:04d}", f"{i - 1:04d}" if i else None, "user", "t" * 5000, 1.0) for i in range(30)]
    got = rows(chat.formatted(spark.createDataFrame(m, SCHEMA)))
    assert len(got) == 1 and got[0][3] == 30 and len(got[0][4]) > 150_000


def test_alternatives_and_long_turn_numbers(spark):
    t = 1_700_000_000
    c = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a reply"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", "thanks"),
        (2, t, "user", "one"), (2, t + 1, "assistant", "two"), (2, t + 9, "user", "three"),
    ]
    messages = chat.from_turns(spark.createDataFrame(c, "conv_id long, turn long, role string, text string"))
    got = [(g[0], g[1], g[3], g[4].replace("<|end|>", "").split()) for g in rows(chat.formatted(messages))]
    assert got == [
        (1, 1, 3, ["<|user|>", "q", "<|assistant|>", "a", "reply", "<|user|>", "thanks"]),
        (1, 2, 2, ["<|user|>", "q", "<|assistant|>", "b"]),
        (2, 1, 3, ["<|user|>", "one", "<|assistant|>", "two", "<|user|>", "three"]),
    ]


def test_trees_may_use_the_same_ids(spark):
    m = [(t, "a", None, "user", f"q{t}", 1.0) for t in (1, 2, None)] + [(t, "b", "a", "assistant", f"r{t}", 1.0) for t in (1, 2, None)]
    got = rows(chat.formatted(spark.createDataFrame(m, SCHEMA)))
    assert sorted((g[0], g[3], g[4].split()[1]) for g in got if g[0]) == [(1, 2, "q1"), (2, 2, "q2")] and [g[4].split()[1] for g in got if g[0] is None] == ["qNone"]


def test_the_least_score_of_a_repeated_id_counts(spark):
    m = [(1, "a", None, "user", "x", s) for s in (5.0, 2.0, 9.0)]
    assert [g[2] for g in rows(chat.formatted(spark.createDataFrame(m, SCHEMA)))] == [2.0]


def test_halfway_replies_branch(spark):
    c = [(1, 10 * k, ("user", "assistant")[k % 2], f"t{k} " + "x" * k) for k in range(8)]
    messages = chat.from_turns(spark.createDataFrame(c, "conv_id long, turn long, role string, text string"), chat.reply_halfway)
    got = [([p["turn"] // 10 for p in r.path]) for r in chat.branches(messages).collect()]
    assert sorted(got) == [[0, 1, 2, 5], [0, 1, 2, 7], [0, 1, 4], [0, 3, 6]]

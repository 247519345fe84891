"""Counts against encoding, and rollups against recounting."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import rollup, tokencount
from tests.llm.helpers import clashing, docs, rows

CHANGE = "op string, doc_id long, source string, lang string, text string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(alphabet=" \n\t'stlldreve aé1½日𝒳", max_size=60)), min_size=1, max_size=5))
def test_counts_equal_encoding(texts):
    c = tokencount.counter(tokencount.FOLDER, rollup.VERSIONS)
    got = c.count(pa.array(texts, pa.string()))
    for code, row in zip(c.codes, got):
        assert row.tolist() == [len(code.encode_ordinary(t or "")) for t in texts]


def _count(text: str | None) -> list[int]:
    return [int(x[0]) for x in tokencount.counter(tokencount.FOLDER, rollup.VERSIONS).count(pa.array([text], pa.string()))]


def _totals(state: list[tuple]) -> list[tuple]:
    sums: dict[tuple, Counter] = {}
    for _, source, lang, text in state:
        for name, n in zip(rollup.VERSIONS, _count(text)):
            c = sums.setdefault((source, lang, name), Counter())
            c.update({"d": 1, "t": n, "c": len(text or "")})
    return sorted(((*k, c["d"], c["t"], c["c"]) for k, c in sums.items()), key=repr)


def test_batches_equal_recounting(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "roll"))
    r = random.Random(3)
    state: list[tuple] = []
    for step in range(4):
        made = [("insert", step * 100 + i, r.choice(("s", None)), r.choice(("en", "de", None)), r.choice((None, "", "some words here", "übrige Wörter " * r.randint(1, 9)))) for i in range(8)]
        ids = [x[0] for x in state]
        gone = r.sample(ids, min(2, len(ids)))
        new = [("revise", d, "s", "fr", "another text of it") for d in r.sample([x for x in ids if x not in gone], min(2, max(0, len(ids) - 2)))]
        changes = made + [("delete", d, None, None, None) for d in gone] + [("delete", 9999, None, None, None), ("revise", 9998, "s", "en", "not there")] + new
        df = spark.createDataFrame(changes, CHANGE)
        assert store.commit(f"b{step}", df)
        assert not store.commit(f"b{step}", df)  # a retry changes nothing
        drop = set(gone) | {x[1] for x in new}
        state = [x for x in state if x[0] not in drop] + [x[1:] for x in made] + [x[1:] for x in new]
        assert rows(store.totals()) == _totals(state)


def test_repeats_within_a_batch(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "roll"))
    with pytest.raises(ValueError):
        store.totals()
    store.commit("a", spark.createDataFrame([("insert", 1, "s", "en", "one two"), ("insert", 1, "s", "en", "one two"), ("insert", None, "s", "en", "x")], CHANGE))
    assert rows(store.totals()) == _totals([(1, "s", "en", "one two")] * 2 + [(None, "s", "en", "x")])
    store.commit("b", spark.createDataFrame([("delete", 1, None, None, None), ("delete", 1, None, None, None), ("revise", 1, "s", "en", "b"), ("revise", 1, "s", "en", "a"), ("delete", None, None, None, None)], CHANGE))
    assert rows(store.totals()) == _totals([(1, "s", "en", "a"), (None, "s", "en", "x")])
    assert store.commit("c", spark.createDataFrame([], CHANGE))
    assert store.batches() == ["a", "b", "c"] and rows(store.totals()) == _totals([(1, "s", "en", "a"), (None, "s", "en", "x")])


def test_whole_table_with_long_text_and_more_columns(spark):
    texts = ["word " * 100_000, None, "", "b b b"]
    got = rows(rollup.totals_of(clashing(docs(spark, texts))))
    assert got == _totals([(i, f"src{i % 2}", "en", t) for i, t in enumerate(texts)])
    assert rollup.totals_of(docs(spark, ["x"]).limit(0)).count() == 0


def test_the_whole_table_is_deleted_and_revised_over(spark, tmp_path):
    texts = [f"some words {'and more ' * (i % 7)}{i}" for i in range(60)] + ["x y", "x y z", "null id", "null id", None, ""]
    ids = [*range(60), 7, 7, None, None, 100, 101]
    table = docs(spark, texts, ids)
    ops = [{r["op"]: r["count"] for r in b.groupBy("op").count().collect()} for b in rollup.changes_of(table)]
    assert all(set(x) == {"insert"} for x in ops[:-2]) and set(ops[-2]) == {"delete", "revise"} and len(ops) == rollup.PARTS + 2
    assert sum(ops[-2].values()) == 64  # every row but those of no id
    store = rollup.Rollup(spark, str(tmp_path / "roll"))
    for k, b in enumerate(rollup.changes_of(table)):
        assert store.commit(str(k), b)
        assert not store.commit(str(k), b)
    want = _totals([(d, f"src{i % 2}", "en", t) for i, (d, t) in enumerate(zip(ids, texts))])
    assert rows(store.totals()) == want == rows(rollup.totals_of(table))


def test_a_revision_of_a_deleted_document_changes_nothing(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "roll"))
    store.commit("a", spark.createDataFrame([("insert", 1, "s", "en", "one two"), ("insert", 2, "s", "en", "three")], CHANGE))
    store.commit("b", spark.createDataFrame([("delete", 1, None, None, None)], CHANGE))
    store.commit("c", spark.createDataFrame([("revise", 1, "s", "en", "one two three four"), ("delete", 1, None, None, None)], CHANGE))
    assert rows(store.totals()) == _totals([(2, "s", "en", "three")])
    store.commit("d", spark.createDataFrame([("insert", 1, "s", "en", "back")], CHANGE))
    store.commit("e", spark.createDataFrame([("revise", 1, "t", "de", "again")], CHANGE))
    assert rows(store.totals()) == _totals([(2, "s", "en", "three"), (1, "t", "de", "again")])
    small = store.compact()
    assert small.count() == 2 * len(rollup.VERSIONS)
    assert rows(small.groupBy(*rollup.GROUP).agg(*[F.sum(c) for c in rollup.MEASURES])) == rows(store.totals())


def test_of_two_commits_of_one_id_one_is_applied(spark, tmp_path):
    folder = str(tmp_path / "roll")
    one, two = rollup.Rollup(spark, folder), rollup.Rollup(spark, folder)
    change = rollup.counted(docs(spark, ["a b"]))
    assert one._commit("x", change)  # both have seen that it was not there
    assert not two._commit("x", change)
    assert one.batches() == ["x"] and rows(one.totals()) == _totals([(0, "src0", "en", "a b")])
    assert not list((tmp_path / "roll" / "staged").iterdir()) and {p.name for p in (tmp_path / "roll" / "batches" / "x").iterdir() if p.is_dir()} == {"deltas", "sums"}

"""Steps whose cost a task of a large table must not bear alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, dense, graph, lexical, sizes
from quern.plans import catalogue


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """12,000 parts of two brands in one file."""
    folder = str(tmp_path_factory.mktemp("parts"))
    cols = ["id AS p_partkey", "concat('name ', id) AS p_name", "concat('Brand#', id % 2) AS p_brand", "'SMALL' AS p_type", "CAST(id % 50 AS INT) AS p_size"]
    spark.range(0, 12_000, 1, 1).selectExpr(*cols).write.parquet(f"{folder}/part.parquet")
    return folder


def test_spread(spark):
    df = sizes.spread(spark.range(0, 1001, 1, 1), 100)
    assert df.rdd.getNumPartitions() == 11 and df.count() == df.distinct().count() == 1001
    assert sizes.spread(spark.range(0)).count() == 0


@pytest.mark.parametrize("name", ["chunk_made", "sanitise_made", "read_html", "read_rtf"])
def test_rows_of_one_file_are_dealt_out(spark, parts, name):
    assert catalogue.queries()[name](spark, parts).rdd.getNumPartitions() == 3


def test_words_are_counted_where_they_decide():
    for size in (100, 127, 128, 129, 255, 256, 257, 300):
        for t in ("a " * size, "ab " * size, "x" * size, "a\n\n" * size, "é " * size):
            assert chunking._too_long(t, 0, len(t), 64) == (chunking.count_tokens(t) > 64)
    # a word cut by a long unit goes on into none of the next
    t = "x" * 1200 + "\n\n" + "a " * 90 + "\n\n" + "b"
    got = chunking.chunk_text(t, limits=chunking.Limits(64, 0))
    assert all(c.token_count <= 64 for c in got) and "".join(c.text for c in got).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")


def test_pairs_apart_are_those_without_an_edge(spark):
    members = spark.createDataFrame([(g, i) for g in range(6) for i in (g % 3, g % 4, 5, 6)] + [(None, 1)], "g long, i long")
    kinds = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, None), (5, "y"), (5, "x"), (5, "x")], "i long, k string")
    two = kinds.selectExpr("i AS dst", "k AS k2")
    edges = kinds.join(two, kinds["k"] == two["k2"]).selectExpr("i AS src", "dst")
    want = graph.unconnected_pairs(members, "g", "i", edges, 1)
    got = graph.apart(members, "g", "i", kinds, "i", "k", 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_pairs_apart_need_no_rows_of_edges(spark, tmp_path):
    """20,000 suppliers of one nation would be 200 million edges."""
    spark.range(0, 20_000, 1, 1).selectExpr("id AS s_suppkey", "0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(0, 40_000, 1, 1).selectExpr("id % 100 AS l_orderkey", "id % 100 + id % 2 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    q = catalogue.queries()["cooccurrence_without_edge"](spark, str(tmp_path))
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert q.count() == 0 and plan.count("supplier") <= 2 and "s_nationkey" in plan and plan.count("Join Inner") == 1


@pytest.fixture(scope="module")
def texts(spark):
    """300 texts of 40, so that most scores are tied."""
    d = [(i, " ".join(["river", "stones", "budget", "of", "the"][: i % 5 + 1] * (i % 8 + 1))) for i in range(300)] + [(900, None), (901, "")]
    asked = spark.createDataFrame([(1, "the rivers of stone"), (2, "budgets budget"), (3, "nowhere"), (4, "")], "q long, text string")
    return spark.createDataFrame(d, "id long, text string").repartition(3), asked


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_blocks_rank_as_joins_do(spark, texts, k, monkeypatch):
    docs, asked = texts
    scope = docs.where("id % 3 > 0").select("id")
    direct = rows(lexical.search(docs, "id", "text", asked, "q", k))
    kept = [rows(lexical.bm25(lexical.indexed(docs, "id", "text"), "id", asked, "q", k, s)) for s in (None, scope)]
    monkeypatch.setattr(lexical, "CELLS", 0)
    joined = [rows(lexical.bm25(lexical.indexed(docs, "id", "text"), "id", asked, "q", k, s)) for s in (None, scope)]
    assert direct == kept[0] == joined[0] and kept[1] == joined[1] and joined[0] and joined[1] != joined[0]
    monkeypatch.setattr(lexical, "CELLS", 256)  # blocks of 64 texts
    assert rows(lexical.search(docs, "id", "text", asked, "q", k)) == direct


def test_repeated_ids_are_summed(spark, texts, monkeypatch):
    docs, asked = texts
    twice = docs.selectExpr("id % 100 AS id", "text")
    got = rows(lexical.search(twice, "id", "text", asked, "q", 9))
    monkeypatch.setattr(lexical, "CELLS", 0)
    assert got == rows(lexical.search(twice, "id", "text", asked, "q", 9)) and got


def test_searches_join_no_text_with_a_query(spark, texts):
    """A row a text, term and query was summed before."""
    docs, asked = texts
    plan = lexical.search(docs, "id", "text", asked, "q", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_stored_postings_may_repeat(spark, texts, tmp_path):
    from quern.catalog import Catalog

    docs, asked = texts
    store = Catalog(spark, str(tmp_path))
    own = docs.selectExpr("CAST(id AS string) AS chunk_id", "'body' AS field", "text")
    store.index_texts(own)
    once = rows(store.bm25("body", asked, "q", 9))
    store.index_texts(own.where("chunk_id < 150"))
    assert rows(store.bm25("body", asked, "q", 9)) == once and once


def moved(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def held(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet")) if folder.exists() else 0


def test_intake_writes_once_and_shuffles_no_text(spark, tmp_path):
    """An empty store's intake shuffled 7 times its texts and wrote them 5 times."""
    from quern import intake
    from quern.catalog import Catalog

    r = np.random.default_rng(3)
    texts = [" ".join(f"{x:08x}" for x in r.integers(0, 1 << 32, 1000)) for _ in range(300)]
    size = sum(map(len, texts))
    rows_ = [(f"d{i}.txt", "file:///d", bytearray(t.encode()), None) for i, t in enumerate(texts)] + [("bad.json", "file:///d", bytearray(b"{"), None), ("no.txt", "file:///d", None, "refused")]
    found = spark.createDataFrame(rows_, "external_id string, uri string, content binary, error string")
    store, before = Catalog(spark, str(tmp_path / "store")), moved(spark)
    told = intake.ingest_files(store, found, "w")
    assert moved(spark) - before < size / 10
    assert held(tmp_path / "store/_staged") < size / 20 < held(tmp_path / "store/version")
    assert sorted(map(tuple, told.groupBy("outcome").count().collect())) == [("failed", 2), ("ingested", 300)]
    assert store.read("version").count() == 300 and store.read("length").where("field = 'body'").count() == store.read("chunk").count()
    # again: contents are shuffled once, to find what differs
    before = moved(spark)
    again = found.withColumn("content", F.when(F.col("external_id") == "d7.txt", F.lit(b"changed")).otherwise(F.col("content")))
    told = intake.ingest_files(store, again, "w")
    assert moved(spark) - before < 1.3 * size
    assert sorted(map(tuple, told.groupBy("outcome").count().collect())) == [("failed", 2), ("ingested", 1), ("unchanged", 299)]
    assert [(r.version_no, r.text) for r in store.read("version").where("version_no > 1").collect()] == [(2, "changed")]


def test_few_partitions_are_dealt_out_and_many_left(spark):
    cores, df = spark.sparkContext.defaultParallelism, spark.range(0, 9, 1, 1)
    for lying, n, want in ((1, 9, min(3, cores)), (1, 3, 1), (cores, 10_000, 1), (1, 10_000, cores), (1, 0, 1)):
        assert sizes.dealt(df, lying, n, 3).rdd.getNumPartitions() == want


def test_intake_broken_off_is_repeated(spark, tmp_path, monkeypatch):
    """Until its version is there a document is new; what was left of it counts once."""
    from quern import intake
    from quern.catalog import Catalog

    found = spark.createDataFrame([(f"{i}.txt", "file:///d", bytearray(b"stone %d" % i), None) for i in range(4)], "external_id string, uri string, content binary, error string")
    store, adopt = Catalog(spark, str(tmp_path)), Catalog.adopt

    def broken(self, name, folder):
        if name == "version":
            raise OSError("full")
        adopt(self, name, folder)

    with monkeypatch.context() as m:
        m.setattr(Catalog, "adopt", broken)
        with pytest.raises(OSError):
            intake.ingest_files(store, found, "w")
    assert store.read("version").count() == 0 and store.chunks().count() == 0
    assert {r.outcome for r in intake.ingest_files(store, found, "w").collect()} == {"ingested"}
    asked = spark.createDataFrame([(1, "stones")], "q long, text string")
    assert store.chunks().count() == store.read("change_event").count() == store.bm25("body", asked, "q", 9).count() == 4


def test_staged_files_are_moved_or_the_move_fails(spark, tmp_path):
    from quern.catalog import Catalog

    store = Catalog(spark, str(tmp_path / "store"))
    store.adopt("length", str(tmp_path / "none"))
    own = spark.range(4).selectExpr("CAST(id AS string) AS chunk_id", "1 AS size", "'body' AS field", "id % 2 AS other")
    for n in (4, 8):
        staged = store.stage(str(tmp_path / f"staged{n}"), own, ["other", "field"])
        assert rows(staged.select("chunk_id", "other")) == [("0", 0), ("1", 1), ("2", 0), ("3", 1)]
        store.adopt("length", str(tmp_path / f"staged{n}"))
        assert store.read("length").where("field = 'body'").count() == n and not held(tmp_path / f"staged{n}")


def test_files_of_brands_lie_apart(spark, parts):
    """Two brands were one task's."""
    df = catalogue.queries()["read_pptx"](spark, parts)
    assert df.rdd.getNumPartitions() == 2 and df.count() == 2


def test_bounds_of_the_kth_are_close_and_never_above():
    x = np.random.default_rng(1).normal(size=(40, 2048)).astype(np.float32)
    for k in (1, 10, 50, 3000):
        bound, kth = dense._kth(x, k), np.sort(x, axis=1)[:, -min(k, 2048)]
        assert (bound <= kth).all() and (k > 2048 or ((x >= bound[:, None]).sum(1) <= 2 * k).all())


def test_nearest_with_ties_and_repeats(spark):
    """Single precision only narrows: near ties and repeated ids as in double."""
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 8))
    v = [(i % 350, [float(y) for y in base[i % 30] + r.normal(size=8) * 1e-6]) for i in range(400)] + [(500, [0.0] * 8)]
    e = spark.createDataFrame(v, "id long, v array<double>")
    got = rows(dense.nearest_batch(e, "id", "v", e.where("id < 60").selectExpr("id AS q", "v AS qv"), "q", "qv", 5, True, 128).where("q >= 50").select("q", "id", "score", "rank"))
    want = []
    for q, a in ((i, np.array(x)) for i, x in v if 50 <= i < 60):
        s = sorted((-round(float(a @ np.array(x) / (np.linalg.norm(a) * (np.linalg.norm(x) or 1))), 6), i) for i, x in v if i != q)
        want += [(q, i, -c, n) for n, (c, i) in enumerate(s[:5], 1)]
    assert [(a, b, d) for a, b, _, d in got] == sorted((a, b, d) for a, b, _, d in want)

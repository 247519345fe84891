"""Lexical, dense and hybrid search over tables, and their measurement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.functions import stem, vectors
from quern.operators import dense, fusion, graph, hybrid, lexical, measure
from quern.plans import stems
from quern.plans.tables import table
from quern.settings import Retrieval

QUERY = "that the erestly of and heonha in the than erst"
K = 10


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(stem.counted(_docs(spark, sf_dir), "doc_id", "text"), "doc_id").select("doc_id", "term", "tf", "size")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(postings(spark, sf_dir))


def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems of each turn, in order."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(stem.stemmed("text"), " ").alias("stems"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(QUERY).alias("text"))
    return lexical.search(_docs(spark, sf_dir), "doc_id", "text", q, "query_id", K).select("doc_id", "score", "rank")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_docs(spark, sf_dir), "doc_id", "text", _asked(spark, sf_dir), "item_id", K)


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from stored postings: written by the bucket of their terms, of
    which the search reads its own."""
    store = Catalog(spark, f"{graph.shared(spark)}/searching-{uuid.uuid4().hex}")
    store.index_texts(_docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.lit("body").alias("field"), "text"))
    found = store.bm25("body", _asked(spark, sf_dir), "item_id", K)
    return found.select("item_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


def heading_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a turn: its role and its conversation."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_key"), F.array(F.col("role"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))).alias("heading_path"))
    headings = rows.select("turn_key", F.concat_ws(" ", "heading_path").alias("heading"))
    q = spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit("assistants in conversations: 7").alias("text"))
    return lexical.search(headings, "turn_key", "heading", q, "query_id", K).select("turn_key", "score", "rank")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return dense.nearest(e, "vec_id", "embedding", [1.0, -1.0] * 32, K)


def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return dense.nearest_batch(e, "vec_id", "embedding", e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", K, skip_self=True)


def dense_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every hundredth vector with all clusters probed: exact."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.nearest_clustered(e, "vec_id", "embedding", asked, "query_id", "embedding", K, lists=16, probes=16, skip_self=True)


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.missing(_docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


def _arms(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Vectors of documents and items are those of the same number."""
    docs = _docs(spark, sf_dir).withColumn("heading", F.concat_ws(" ", "lang", "source"))
    e = table(spark, sf_dir, "embeddings")
    asked = _asked(spark, sf_dir)
    qv = asked.select("item_id").join(e.select(F.col("vec_id").alias("v"), "embedding"), F.col("item_id") == F.col("v")).select("item_id", "embedding")
    return hybrid.arms(docs, "doc_id", asked, "item_id", heading="heading", vectors=e.select(F.col("vec_id").alias("doc_id"), "embedding"), query_vectors=qv)


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arms(spark, sf_dir)
    return fusion.fuse({n: a[n].select("item_id", "doc_id", "rank") for n in ("dense", "sparse")}, "item_id", "doc_id", 30).select("item_id", "doc_id", "score", "rank")


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.search(_arms(spark, sf_dir), "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hybrid.search(_arms(spark, sf_dir), "item_id", "doc_id")
    bodies = _docs(spark, sf_dir).select(F.col("doc_id").alias("d"), "text")
    return fusion.explain(hits.join(bodies, F.col("doc_id") == F.col("d"), "left").drop("d"), "doc_id", "text").select("item_id", "doc_id", "score", "rank", "ranks")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hybrid.reranked(_arms(spark, sf_dir), _docs(spark, sf_dir), _asked(spark, sf_dir), "item_id", "doc_id")
    return out.select("item_id", "doc_id", "rank", "rerank_score", "rerank")


def golden_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, document) where the whole item stands in the document."""
    return measure.resolve_anywhere(_asked(spark, sf_dir), _docs(spark, sf_dir), "item_id", "doc_id")


def golden_unanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = _asked(spark, sf_dir).select(F.col("item_id").alias("question_id"))
    return measure.unresolved(quotes, golden_resolve(spark, sf_dir).withColumnRenamed("item_id", "question_id")).select(F.col("question_id").alias("item_id"))


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall@5 and @20, nDCG@10 and reciprocal rank of body search."""
    ranked = lexical.search(_docs(spark, sf_dir), "doc_id", "text", _asked(spark, sf_dir), "item_id", 50)
    return measure.score(ranked, golden_resolve(spark, sf_dir), "item_id", "doc_id")


def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.aggregate(retrieval_scores(spark, sf_dir), _asked(spark, sf_dir).count())


def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arms(spark, sf_dir)
    a["hybrid"] = fusion.fuse({n: x.select("item_id", "doc_id", "rank") for n, x in a.items()}, "item_id", "doc_id", Retrieval().fuse_to).select("item_id", "doc_id", "rank")
    return measure.compare_arms(a, golden_resolve(spark, sf_dir), "item_id", "doc_id")


QUERIES = {f.__name__: f for f in (postings, term_stats, stemmed_terms, bm25_topk, bm25_batch, bm25_stored, heading_topk, dense_topk, dense_topk_batch, dense_clustered, embedding_norms, missing_vectors, rrf, explain, rerank_overlap, golden_resolve, golden_unanswerable, retrieval_scores, macro_mean, arm_comparison)}
QUERIES["hybrid"] = search_hybrid

_DOC_TERMS = f"SELECT doc_id AS id, {stems.WORDS.format('text')} AS terms FROM documents WHERE doc_id IS NOT NULL"
_ITEM_TERMS = f"SELECT item_id AS q, {stems.WORDS.format('text')} AS terms FROM benchmark WHERE item_id IS NOT NULL"


def _stems(of: str) -> str:
    return stems.stems(f"SELECT DISTINCT unnest(terms) AS word FROM ({of})")


def _bm25_sql(name: str, docs: str, asked: str, k: int) -> str:
    """Common table expressions; the last is ``name`` (q, id, score, rank)."""
    return f"""
{name}_d AS ({docs}), {name}_a AS ({asked}), {name}_x AS ({_stems(f"SELECT terms FROM {name}_d UNION ALL SELECT terms FROM {name}_a")}),
{name}_q AS (SELECT q, stem AS term, count(*) AS w FROM (SELECT q, unnest(terms) AS word FROM {name}_a) JOIN {name}_x USING (word) GROUP BY q, stem),
{name}_p AS (SELECT id, n, stem AS term, count(*) AS tf FROM (SELECT id, len(terms) AS n, unnest(terms) AS word FROM {name}_d) JOIN {name}_x USING (word) GROUP BY id, n, stem),
{name}_c AS (SELECT count(*) AS big_n, avg(len(terms)) AS av FROM {name}_d),
{name}_n AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_s AS (SELECT q, id, round(sum(w * CASE WHEN ln((big_n - df + 0.5) / (df + 0.5)) > 0 THEN ln((big_n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))), 9) AS score
  FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_n USING (term), {name}_c GROUP BY q, id),
{name} AS (SELECT * FROM (SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


_DENSE_SQL = f"""
dense_s AS (SELECT b.item_id AS q, e.vec_id AS id, round({_dot('e.embedding', 'v.embedding')} / (sqrt({_dot('e.embedding', 'e.embedding')}) * sqrt({_dot('v.embedding', 'v.embedding')})), 6) AS score
  FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, embeddings e),
dense AS (SELECT * FROM (SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM dense_s) WHERE rank <= 50)"""
_SPARSE_SQL = _bm25_sql("sparse", _DOC_TERMS, _ITEM_TERMS, 50)
_HEAD_SQL = _bm25_sql("headings", f"SELECT doc_id AS id, {stems.WORDS.format("concat_ws(' ', lang, source)")} AS terms FROM documents WHERE doc_id IS NOT NULL", _ITEM_TERMS, 50)


def _rrf_sql(arms: tuple[str, ...], limit: int) -> str:
    rows = " UNION ALL ".join(f"SELECT q, id, rank, '{a}' AS arm FROM {a}" for a in arms)
    return f"""
arms AS ({rows}),
fused AS (SELECT * FROM (SELECT q, id, score, ranks, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM
  (SELECT q, id, round(list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY rank)), 9) AS score, string_agg(arm || '=' || rank, ', ' ORDER BY arm) AS ranks FROM arms GROUP BY q, id)) WHERE rank <= {limit})"""


_GOLD_SQL = "gold AS (SELECT b.item_id AS q, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '' AND d.doc_id IS NOT NULL AND b.item_id IS NOT NULL)"


def _scores_sql(ranked: str) -> str:
    return f"""
SELECT t.q, round(coalesce(h5, 0) / n, 6) AS recall_at_5, round(coalesce(h20, 0) / n, 6) AS recall_at_20, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least(n, 10)) s(i)), 6) AS ndcg_at_10, round(coalesce(1.0::DOUBLE / best, 0), 6) AS rr
FROM (SELECT q, count(*) AS n FROM gold GROUP BY q) t LEFT JOIN (SELECT q, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 20) AS h20, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) AS best FROM gold JOIN {ranked} USING (q, id) GROUP BY q) h ON h.q = t.q"""


_MEANS = "round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_20), 6) AS recall_at_20, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(rr), 6) AS rr"
_ALL_ARMS = f"WITH {_DENSE_SQL}, {_SPARSE_SQL}, {_HEAD_SQL}, {_rrf_sql(('dense', 'headings', 'sparse'), 30)}"
_TERMS_SQL = f"d AS ({_DOC_TERMS}), x AS ({_stems('SELECT terms FROM d')}), t AS (SELECT id AS doc_id, size, stem AS term FROM (SELECT id, len(terms) AS size, unnest(terms) AS word FROM d) JOIN x USING (word))"
SQL = {
    "postings": f"WITH {_TERMS_SQL} SELECT doc_id, term, CAST(count(*) AS INT) AS tf, CAST(size AS INT) AS size FROM t GROUP BY doc_id, term, size",
    "term_stats": f"WITH {_TERMS_SQL} SELECT term, count(DISTINCT doc_id) AS n, count(*) AS total FROM t GROUP BY term",
    "stemmed_terms": f"""
WITH d AS (SELECT conv_id, turn, {stems.WORDS.format('text')} AS terms FROM conversations), x AS ({_stems('SELECT terms FROM d')}),
t AS (SELECT conv_id, turn, unnest(terms) AS word, generate_subscripts(terms, 1) AS i FROM d)
SELECT d.conv_id, d.turn, coalesce(s, '') AS stems FROM d LEFT JOIN (SELECT conv_id, turn, string_agg(stem, ' ' ORDER BY i) AS s FROM t JOIN x USING (word) GROUP BY conv_id, turn) USING (conv_id, turn)
""",
    "bm25_topk": f"WITH {_bm25_sql('r', _DOC_TERMS, f"SELECT 0 AS q, {stems.WORDS.format(repr(QUERY))} AS terms", K)} SELECT id AS doc_id, score, rank FROM r",
    "bm25_batch": f"WITH {_bm25_sql('r', _DOC_TERMS, _ITEM_TERMS, K)} SELECT q AS item_id, id AS doc_id, score, rank FROM r",
    "bm25_stored": f"WITH {_bm25_sql('r', _DOC_TERMS, _ITEM_TERMS, K)} SELECT q AS item_id, id AS doc_id, score, rank FROM r",
    "heading_topk": "WITH " + _bm25_sql("r", f"SELECT conv_id || ':' || turn AS id, {stems.WORDS.format("role || ' conversation ' || conv_id")} AS terms FROM conversations", f"SELECT 0 AS q, {stems.WORDS.format("'assistants in conversations: 7'")} AS terms", K) + " SELECT id AS turn_key, score, rank FROM r",
    "dense_topk": f"""
WITH q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS q)
SELECT vec_id, round({_dot('embedding', 'q')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('q', 'q')})), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT {K}
""",
    "dense_topk_batch": f"""
WITH n AS (SELECT vec_id, embedding, sqrt({_dot('embedding', 'embedding')}) AS nn FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_dot('a.embedding', 'b.embedding')} / (a.nn * b.nn), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= {K}
""",
    "dense_clustered": f"""
WITH n AS (SELECT vec_id, embedding, sqrt({_dot('embedding', 'embedding')}) AS nn FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_dot('a.embedding', 'b.embedding')} / (a.nn * b.nn), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= {K}
""",
    "embedding_norms": f"SELECT vec_id, round(sqrt({_dot('embedding', 'embedding')}), 6) AS norm FROM embeddings",
    "missing_vectors": "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)",
    "rrf": f"WITH {_DENSE_SQL}, {_SPARSE_SQL}, {_rrf_sql(('dense', 'sparse'), 30)} SELECT q AS item_id, id AS doc_id, score, rank FROM fused",
    "hybrid": f"{_ALL_ARMS} SELECT q AS item_id, id AS doc_id, score, rank FROM fused WHERE rank <= 8",
    "explain": f"{_ALL_ARMS} SELECT q AS item_id, id AS doc_id, round(score, 6) AS score, rank, ranks FROM fused WHERE rank <= 8",
    "rerank_overlap": rf"""{_ALL_ARMS},
w AS (SELECT q, id, rank, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda x: x <> '')) AS dw FROM fused JOIN benchmark b ON b.item_id = q JOIN documents d ON d.doc_id = id),
o AS (SELECT q, id, rank, CASE WHEN len(qw) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(qw, dw)) / len(qw), 6) END AS rerank_score FROM w),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY rerank_score DESC, rank, id) AS INT) AS rerank FROM o)
SELECT q AS item_id, id AS doc_id, rank, rerank_score, rerank FROM r WHERE rerank <= 8""",
    "golden_resolve": f"WITH {_GOLD_SQL} SELECT q AS item_id, id AS doc_id FROM gold",
    "golden_unanswerable": f"WITH {_GOLD_SQL} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT q FROM gold)",
    "retrieval_scores": f"WITH {_GOLD_SQL}, {_SPARSE_SQL}, s AS ({_scores_sql('sparse')}) SELECT q AS item_id, recall_at_5, recall_at_20, ndcg_at_10, rr FROM s",
    "macro_mean": f"WITH {_GOLD_SQL}, {_SPARSE_SQL}, s AS ({_scores_sql('sparse')}) SELECT count(*) AS answerable, {_MEANS}, (SELECT count(*) FROM benchmark WHERE item_id IS NOT NULL) - count(*) AS unanswerable FROM s",
    "arm_comparison": f"{_ALL_ARMS}, {_GOLD_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS arm, {_MEANS} FROM ({_scores_sql(r)})" for n, r in (("dense", "dense"), ("headings", "headings"), ("sparse", "sparse"), ("hybrid", "fused"))),
}

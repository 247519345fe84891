"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontam, gif, langid, packing, pii, quality, rollup, simhash, suffixtree
from quern.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.formatted(chat.from_turns(turns, chat.reply_halfway), bodies=chat.bodies_of_turns(turns)).withColumn("n_messages", F.col("n_messages").cast("long"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.rewrite(table(spark, sf_dir, "documents"), pii.key_of(spark), counted="n_replaced")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals_of(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_corpus(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every vector is drawn as a GIF and decoded."""
    got = gif.frames(gif.from_vectors(table(spark, sf_dir, "embeddings")), "vec_id", "gif")
    return got.select("vec_id", "frame", "start_ms", "delay_ms", "width", "height", F.hex("pixels").alias("pixels"), F.array_join("histogram", ",").alias("histogram"), "n_transparent", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_chat_formatting, op2_pii_surrogates, op3_simhash_near_duplicates, op4_token_rollups, op5_quality_classifier)
    made += (op6_lm_scoring, op7_language_id, op8_benchmark_decontamination, op9_best_fit_packing, op10_media_gif)
    return {f.__name__: f for f in made}


#: The k-th turn replies to the last one up to k // 2 of the other side.
OP1_SQL = """
WITH RECURSIVE c AS (SELECT DISTINCT conv_id AS tree_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, dense_rank() OVER (PARTITION BY tree_id ORDER BY turn) - 1 AS k, row_number() OVER (PARTITION BY tree_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS alt FROM c),
m AS (SELECT tree_id, k, alt, {'turn': turn, 'which': md5(coalesce(role, chr(1)) || chr(0) || coalesce(text, chr(1)))} AS id, k // 2 - CASE WHEN (k - k // 2) % 2 = 0 THEN 1 ELSE 0 END AS up, coalesce(length(text), 0) AS score,
  '<|' || CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant') THEN lower(trim(role)) ELSE 'user' END || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\\|') || chr(10) || '<|end|>' AS turned FROM n),
w AS (SELECT tree_id, k, alt, [id] AS path, score AS total, turned AS conversation FROM m WHERE k = 0
  UNION ALL SELECT m.tree_id, m.k, m.alt, list_append(w.path, m.id), w.total + m.score, w.conversation || chr(10) || m.turned FROM w JOIN m ON m.tree_id = w.tree_id AND m.up = w.k AND w.alt = 1),
l AS (SELECT * FROM w WHERE alt > 1 OR NOT EXISTS (SELECT 1 FROM m WHERE m.tree_id = w.tree_id AND m.up = w.k)),
r AS (SELECT tree_id, round(total / len(path), 6) AS score, len(path) AS n_messages, conversation, path FROM l)
SELECT tree_id, CAST(branch_rank AS INT) AS branch_rank, score, n_messages, conversation
FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, n_messages DESC, path) AS branch_rank FROM r) WHERE branch_rank <= 2
"""

#: What the frames must show, from the values that were drawn: the second frame lies
#: on the first and is taken back, the third lies on the first and is cleared with
#: what was under it, the fourth lies on the rest.
OP10_SQL = """
WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
l AS (SELECT vec_id, i // 16 AS f, i % 16 // 4 AS r, i % 4 AS c, (x >= -0.1::DOUBLE)::INT + (x >= 0)::INT + (x >= 0.1::DOUBLE)::INT + (x >= 0.2::DOUBLE)::INT AS k FROM v),
d AS (SELECT vec_id, f, r + [0, 0, 1, 2][f + 1] AS py, c + [0, 1, 0, 2][f + 1] AS px, k FROM l),
g AS (SELECT vec_id, f, py, px FROM (SELECT vec_id FROM embeddings), range(4) a(f), range(6) b(py), range(6) c(px)),
s AS (SELECT g.vec_id, g.f, g.py, g.px, nullif(own.k, 0) AS own, CASE WHEN g.f > 0 AND NOT (g.f = 3 AND third.k IS NOT NULL) THEN nullif(first.k, 0) END AS under
  FROM g LEFT JOIN d own ON own.vec_id = g.vec_id AND own.f = g.f AND own.py = g.py AND own.px = g.px
  LEFT JOIN d first ON first.vec_id = g.vec_id AND first.f = 0 AND first.py = g.py AND first.px = g.px
  LEFT JOIN d third ON third.vec_id = g.vec_id AND third.f = 2 AND third.py = g.py AND third.px = g.px),
p AS (SELECT vec_id, f, py, px, coalesce(own, under, 0) AS k FROM s),
f AS (SELECT vec_id, f AS frame, string_agg(CASE k WHEN 0 THEN '00000000' WHEN 1 THEN '000000FF' WHEN 2 THEN 'FF0000FF' WHEN 3 THEN '00FF00FF' ELSE '0000FFFF' END, '' ORDER BY py, px) AS pixels,
  count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 4) AS n4 FROM p GROUP BY vec_id, f)
SELECT vec_id, CAST(frame AS INT) AS frame, CAST(CASE frame WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 90 ELSE 150 END AS BIGINT) AS start_ms, CAST(40 + 10 * frame AS INT) AS delay_ms, 6 AS width, 6 AS height, pixels,
  n1 || ',0,0,' || n4 || repeat(',0', 8) || ',' || n3 || repeat(',0', 35) || ',' || n2 || repeat(',0', 15) AS histogram, CAST(n0 AS INT) AS n_transparent, CAST(NULL AS VARCHAR) AS error
FROM f
"""


#: Exact containment, by brute force over all shingles.
OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, round(k / n, 6) AS containment, n AS n_shingles
FROM (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE k >= 0.7 * n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op8_benchmark_decontamination": OP8_SQL, "op10_media_gif": OP10_SQL}

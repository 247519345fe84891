"""Hashes, versions and refresh over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import versions
from quern.plans.tables import table

CUT = "2024-01-16"


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", versions.content_hash("text").alias("content_hash"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.exact_duplicates(content_hash(spark, sf_dir), "content_hash", "doc_id")


def _order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the versions of one document."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), versions.content_hash("o_orderstatus").alias("content_hash"))
    return versions.number_versions(o, "document_id", "id")


def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.supersede(_order_versions(spark, sf_dir), "document_id", "id").select("document_id", "id", "version_no", "superseded_by")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(_order_versions(spark, sf_dir), "document_id", "version_no").select("document_id", "id", "version_no")


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    return versions.next_version(_order_versions(spark, sf_dir), docs)


def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks: those of the orders that no later order replaces."""
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("ordinal"))
    return versions.current_only(chunks, versions.supersede(_order_versions(spark, sf_dir), "document_id", "id"))


def unseen_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status differs from that of their customer's last order."""
    v = _order_versions(spark, sf_dir)
    return versions.unseen(v.select("document_id", "id", "content_hash"), versions.latest(v, "document_id", "version_no").select("document_id", "content_hash")).select("document_id", "id")


def refresh_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user last did before and after a day, as two snapshots."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("external_id"), "event_id", "ts", versions.content_hash(F.floor("value").cast("string")).alias("content_hash"))
    snap = lambda rows: versions.latest(rows, "external_id", [F.desc("ts"), F.desc("event_id")])
    cut = F.lit(CUT).cast("timestamp_ntz")
    return versions.classify_refresh(snap(e.where(F.col("ts") < cut)), snap(e.where(F.col("ts") >= cut)))


QUERIES = {f.__name__: f for f in (content_hash, exact_duplicates, supersede_chain, latest_version, next_version, current_chunks, unseen_content, refresh_classify)}

_V = "v AS (SELECT o_custkey AS document_id, o_orderkey AS id, sha256(o_orderstatus) AS content_hash, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version_no FROM orders)"
SQL = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "exact_duplicates": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "supersede_chain": f"WITH {_V} SELECT document_id, id, version_no, lead(id) OVER (PARTITION BY document_id ORDER BY version_no) AS superseded_by FROM v",
    "latest_version": f"WITH {_V} SELECT document_id, max(id) AS id, max(version_no) AS version_no FROM v GROUP BY document_id",
    "next_version": f"WITH {_V}, m AS (SELECT document_id, max(version_no) AS m FROM v GROUP BY 1) SELECT c_custkey AS document_id, coalesce(m, 0) + 1 AS next_no FROM customer LEFT JOIN m ON c_custkey = document_id",
    "current_chunks": "WITH c AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) SELECT l_orderkey AS version_id, l_linenumber AS ordinal FROM lineitem WHERE l_orderkey IN (SELECT k FROM c)",
    "unseen_content": f"WITH {_V}, l AS (SELECT document_id, arg_max(content_hash, version_no) AS h FROM v GROUP BY 1) SELECT v.document_id, v.id FROM v JOIN l USING (document_id) WHERE content_hash <> h",
    "refresh_classify": f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS external_id, event_id, ts, CAST(floor(value) AS BIGINT) AS h FROM events WHERE user_id IS NOT NULL),
b AS (SELECT external_id, arg_max(h, (ts, event_id)) AS h FROM e WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1),
a AS (SELECT external_id, arg_max(h, (ts, event_id)) AS h FROM e WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1)
SELECT coalesce(b.external_id, a.external_id) AS external_id, CASE WHEN b.external_id IS NULL THEN 'new' WHEN a.external_id IS NULL THEN 'disappeared' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS state
FROM b FULL JOIN a ON a.external_id = b.external_id
""",
}

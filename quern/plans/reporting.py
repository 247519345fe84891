"""Governance reports over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import reports
from quern.plans.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
START = "1999-01-01"


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 180).alias("stale"))


def ages_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ages_fastest(_stale(spark, sf_dir), "o_orderkey", "stale", 100).select("o_orderkey", F.col("stale").cast("string").alias("stale"))


def needs_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims whose line items are the evidence."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", 0.6).otherwise(0.9).alias("confidence"))
    return reports.needs_evidence(a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assertion_id")))


def needs_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line item asks for."""
    return reports.needs_owner(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", table(spark, sf_dir, "lineitem"), "l_partkey")


def may_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "disputed").otherwise("active").alias("status"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("object"), F.lit("status").alias("predicate"))
    return reports.may_change(o).select("o_orderkey", "status", "object")


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cadence(table(spark, sf_dir, "events"), "user_id", "ts")


def schedule_24m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.schedule(_stale(spark, sf_dir), "stale", START).select(F.col("month").cast("string").alias("month"), "n")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts({n: table(spark, sf_dir, n) for n in TABLES})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer, of its orders as claims."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit("explicit").alias("modality"), F.lit(1.0).alias("confidence"))
    return reports.pages(a)


QUERIES = {f.__name__: f for f in (ages_fastest, needs_evidence, needs_owner, may_change, cadence, schedule_24m, table_counts, pages)}

SQL = {
    "ages_fastest": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 180 AS VARCHAR) AS stale FROM orders WHERE o_orderdate IS NOT NULL ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 100",
    "needs_evidence": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n_evidence, CASE WHEN o_orderstatus = 'P' THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM orders LEFT JOIN n ON l_orderkey = o_orderkey) SELECT * FROM a WHERE n_evidence <= 1 OR confidence < 0.7",
    "needs_owner": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)",
    "may_change": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'disputed' ELSE 'active' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS object FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'",
    "cadence": "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g FROM events) SELECT user_id, count(*) AS n, round(avg(g), 3) AS mean_gap_s FROM g GROUP BY user_id",
    "schedule_24m": f"SELECT CAST(CAST(date_trunc('month', CAST(o_orderdate AS DATE) + 180) AS DATE) AS VARCHAR) AS month, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) + 180 >= DATE '{START}' AND CAST(o_orderdate AS DATE) + 180 < DATE '{START}' + INTERVAL 24 MONTH GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES),
    "pages": "SELECT o_custkey AS subject_id, string_agg(l, chr(10) ORDER BY l) AS page FROM (SELECT o_custkey, '- order ' || o_orderkey || ': ' || o_orderstatus || ' (explicit, 1.00)' AS l FROM orders) GROUP BY 1",
}

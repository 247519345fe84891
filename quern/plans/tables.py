"""Tables of a folder, and what several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: a user's event of a type holds until the next of its kind."""
    from quern.operators.ledger import open_interval

    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), F.col("value").alias("object"), F.col("ts").alias("asserted_at"))
    return open_interval(e, ["subject_id", "predicate"], "asserted_at")


#: The same in SQL, as a common table expression named facts.
FACTS_SQL = """facts AS (SELECT event_id, user_id AS subject_id, event_type AS predicate, value AS object, ts AS asserted_at,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at FROM events)"""

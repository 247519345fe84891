"""The assertion ledger over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import ledger, versions
from quern.plans.tables import FACTS_SQL, events_as_facts, table

AT = "2024-01-16"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims of each predicate there are, and how many are over."""
    f = events_as_facts(spark, sf_dir)
    return f.groupBy("predicate").agg(F.count("*").alias("n"), F.count("invalid_at").alias("n_over"), F.count_distinct("subject_id").alias("n_subjects"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.active(events_as_facts(spark, sf_dir)).select("event_id", "subject_id", "predicate", "object")


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events_as_facts(spark, sf_dir).withColumn("asserted_at", F.col("asserted_at").cast("timestamp")).withColumn("invalid_at", F.col("invalid_at").cast("timestamp"))
    return ledger.as_of(f, AT).select("event_id", "subject_id", "predicate", "object")


def as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's midnight saw, for every day of the events."""
    f = events_as_facts(spark, sf_dir).withColumn("asserted_at", F.col("asserted_at").cast("timestamp")).withColumn("invalid_at", F.col("invalid_at").cast("timestamp"))
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).distinct()
    seen = ledger.as_of_many(f, days)
    return seen.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "predicate").agg(F.count("*").alias("n"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts; invalidations of those whose successor has a lower value; disputes
    of neighbours whose values have the same whole part."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), F.col("value").alias("object"), F.col("ts").alias("asserted_at"))
    w = Window.partitionBy("subject_id", "predicate").orderBy("asserted_at", "id")
    n = e.withColumn("next_id", F.lead("id").over(w)).withColumn("next_object", F.lead("object").over(w)).withColumn("next_at", F.lead("asserted_at").over(w))
    ended = n.where("next_object < object").select(F.col("id").alias("assertion_id"), F.col("next_at").alias("invalid_at"), F.lit("superseded").alias("invalidation_reason"), F.col("next_id").alias("invalidated_by"))
    disputes = n.where("floor(next_object) = floor(object)").select(F.col("id").alias("a"), F.col("next_id").alias("b"))
    return e, ended, disputes


def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.state(*_changes(spark, sf_dir)).select("id", "status", "invalidated_by")


def reconcile_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a day against what held the day before."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").select("event_id", F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), F.floor("value").cast("string").alias("object"), F.col("ts").alias("asserted_at"))
    cut = F.lit(AT).cast("timestamp_ntz")
    held = versions.latest(e.where(F.col("asserted_at") < cut), ["subject_id", "predicate"], [F.desc("asserted_at"), F.desc("event_id")])
    return ledger.reconcile(e.where(F.col("asserted_at") >= cut), held).select("event_id", "subject_id", "predicate", "kind", "prior_object", "asserted_at")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_kinds(spark, sf_dir).drop("asserted_at")


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of change of each day, with the subjects of those that are news."""
    days = reconcile_kinds(spark, sf_dir).withColumn("run_id", F.date_format("asserted_at", "yyyy-MM-dd"))
    return ledger.change_report(days)


def stale_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = events_as_facts(spark, sf_dir).select("event_id", F.col("predicate").alias("doc_type"), "asserted_at", F.lit(None).cast("date").alias("valid_to"))
    return ledger.stale_after(view, {"signup": 90, "purchase": 120}).select("event_id", F.col("stale_after").cast("string").alias("stale_after"))


def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_cost(table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("value").cast("decimal(18,4)").alias("cost_usd"))).select(F.col("cost_usd").cast("double").alias("cost_usd"))


QUERIES = {f.__name__: f for f in (assertions, active, as_of, as_of_many, ledger_state, change_report, stale_after, run_cost)}
QUERIES["reconcile_kinds"] = reconciled

_NEXT = "n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(value) OVER w AS next_value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"
_KINDS = f"""
e AS (SELECT event_id, user_id AS subject_id, event_type AS predicate, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS object, ts FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
h AS (SELECT subject_id, predicate, arg_max(object, (ts, event_id)) AS prior_object FROM e WHERE ts < TIMESTAMP '{AT}' GROUP BY 1, 2),
k AS (SELECT event_id, subject_id, predicate, CASE WHEN prior_object IS NULL THEN 'new' WHEN object = prior_object THEN 'confirmed' ELSE 'outdated' END AS kind, prior_object, ts FROM e LEFT JOIN h USING (subject_id, predicate) WHERE ts >= TIMESTAMP '{AT}')"""
SQL = {
    "assertions": f"WITH {FACTS_SQL} SELECT predicate, count(*) AS n, count(invalid_at) AS n_over, count(DISTINCT subject_id) AS n_subjects FROM facts GROUP BY predicate",
    "active": f"WITH {FACTS_SQL} SELECT event_id, subject_id, predicate, object FROM facts WHERE invalid_at IS NULL",
    "as_of": f"WITH {FACTS_SQL} SELECT event_id, subject_id, predicate, object FROM facts WHERE asserted_at <= TIMESTAMP '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AT}')",
    "as_of_many": f"WITH {FACTS_SQL}, d AS (SELECT DISTINCT date_trunc('day', ts) AS t0 FROM events) SELECT strftime(t0, '%Y-%m-%d') AS day, predicate, count(*) AS n FROM facts JOIN d ON asserted_at <= t0 AND (invalid_at IS NULL OR invalid_at > t0) GROUP BY 1, 2",
    "ledger_state": f"""WITH {_NEXT}, x AS (SELECT event_id AS i FROM n WHERE floor(next_value) = floor(value) UNION SELECT next_id FROM n WHERE floor(next_value) = floor(value))
SELECT event_id AS id, CASE WHEN next_value < value THEN 'invalidated' WHEN event_id IN (SELECT i FROM x) THEN 'disputed' ELSE 'active' END AS status, CASE WHEN next_value < value THEN next_id END AS invalidated_by FROM n""",
    "reconcile_kinds": f"WITH {_KINDS} SELECT event_id, subject_id, predicate, kind, prior_object FROM k",
    "change_report": f"WITH {_KINDS} SELECT strftime(ts, '%Y-%m-%d') AS run_id, kind, count(*) AS n, coalesce(string_agg(DISTINCT CASE WHEN kind <> 'confirmed' THEN CAST(subject_id AS VARCHAR) END, ',' ORDER BY CASE WHEN kind <> 'confirmed' THEN CAST(subject_id AS VARCHAR) END), '') AS subjects FROM k GROUP BY 1, 2",
    "stale_after": "SELECT event_id, CAST(CAST(ts AS DATE) + CASE event_type WHEN 'signup' THEN 90 WHEN 'purchase' THEN 120 ELSE 180 END AS VARCHAR) AS stale_after FROM events",
    "run_cost": "SELECT CAST(coalesce(sum(CAST(value AS DECIMAL(18, 4))), 0) AS DOUBLE) AS cost_usd FROM events",
}

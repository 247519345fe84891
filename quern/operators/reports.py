"""Governance reports over the ledger's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sizes import union


def ages_fastest(view: DataFrame, id_: str, stale: str, k: int | None = None) -> DataFrame:
    out = view.where(F.col(stale).isNotNull()).select(id_, stale).orderBy(stale, id_)
    return out if k is None else out.limit(k)


def needs_evidence(assertions: DataFrame, evidence: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, n_evidence, confidence): one quote only, or little confidence."""
    n = evidence.groupBy(F.col("assertion_id").alias("__a")).agg(F.count("*").alias("n"))
    out = assertions.join(n, assertions["id"] == F.col("__a"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_evidence"), "confidence")
    return out.where((F.col("n_evidence") <= 1) | (F.col("confidence") < least))


def needs_owner(items: DataFrame, id_: str, owners: DataFrame, owned: str) -> DataFrame:
    o = owners.select(F.col(owned).alias("__o"))
    return items.join(o, items[id_] == F.col("__o"), "left_anti")


def may_change(view: DataFrame) -> DataFrame:
    """Disputed or pending claims, and those with an open condition."""
    return view.where("status = 'disputed' OR object = 'pending' OR predicate = 'condition'")


def cadence(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, n, mean_gap_s): the observed rhythm of each source."""
    gap = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(Window.partitionBy(key).orderBy(at, *[c for c in ("event_id", "o_orderkey") if c in events.columns]))
    return events.withColumn("__g", gap).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("__g"), 3).alias("mean_gap_s"))


def schedule(view: DataFrame, stale: str, start: str, months: int = 24) -> DataFrame:
    """(month, n): what falls due in each of the next months."""
    first = F.trunc(F.lit(start).cast("date"), "MM")
    month = F.trunc(F.col(stale).cast("date"), "MM")
    return view.where((month >= first) & (month < F.add_months(first, months))).groupBy(month.alias("month")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the share of rows in which each field is set; 0 for no rows."""
    return df.agg(*[F.round(F.coalesce(F.avg(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias(f) for f in fields])


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return union([tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in sorted(tables)])


def pages(assertions: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(subject, page): the claims of each subject as text, rebuilt at will."""
    line = F.concat(F.lit("- "), F.col("predicate"), F.lit(": "), F.coalesce(F.col("object"), F.lit("?")), F.lit(" ("), F.col("modality"), F.lit(", "), F.format_string("%.2f", "confidence"), F.lit(")"))
    return assertions.groupBy(subject).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("page"))

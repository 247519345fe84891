"""The assertion ledger: append-only facts and events, bitemporal views.

Facts are never changed.  Invalidations and disputes are events; state is a
join of facts with them.  World time is valid_from to valid_to, system time
asserted_at to invalid_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import LedgerError, NotFound
from quern.functions import text

REASONS = ("superseded", "contradicted", "corrected", "source_withdrawn")
KINDS = ("new", "confirmed", "outdated", "contradicted", "action_completed", "owner_changed", "question_raised")

#: The least similarity of a quote that is not held as it is.
FUZZY = 0.95


def rejected(assertions: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rules: the rest may be appended."""
    rules = {
        "no evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "an empty quote": F.exists(F.coalesce("evidence", F.array().cast(assertions.schema["evidence"].dataType)), lambda e: F.coalesce(F.trim(e["quote"]), F.lit("")) == ""),
        "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "inferred with full confidence": (F.col("modality") == "inferred") & (F.col("confidence") >= 1),
        "valid_to before valid_from": F.col("valid_to") < F.col("valid_from"),
    }
    why = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return assertions.withColumn("why", why).where("size(why) > 0")


def accepted(assertions: DataFrame) -> DataFrame:
    bad = rejected(assertions).select(F.col("id").alias("__bad"))
    return assertions.join(bad, assertions["id"] == F.col("__bad"), "left_anti")


def evidence_of(assertions: DataFrame) -> DataFrame:
    """One row for each quote; a (assertion, chunk, quote) is there once."""
    rows = assertions.select(F.col("id").alias("assertion_id"), F.inline("evidence"))
    return rows.dropDuplicates(["assertion_id", "chunk_id", "quote"])


def verify_quotes(evidence: DataFrame, chunks: DataFrame, least: float = FUZZY) -> DataFrame:
    """Adds ``similarity`` and ``verified``: the chunk holds the quote, white space and
    case apart (1.0), or some passage of the quote's length that begins at a word is as
    near to it by edit distance as ``least`` says.  Only quotes that are not held exactly
    are measured."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    c = chunks.select(F.col("id").alias("__c"), F.col("text").alias("__t"))
    joined = evidence.join(c, evidence["chunk_id"] == F.col("__c"), "left")
    joined = joined.withColumn("__t", plain(F.col("__t"))).withColumn("__q", F.trim(plain(F.col("quote"))))
    size = F.char_length("__q")
    # where each word begins, from 1: the blanks before it end there
    begins = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length("__t"), F.lit(1))), lambda i: F.substring(F.col("__t"), i, F.lit(1)).rlike(r"\w") & ((i == 1) | ~F.substring(F.col("__t"), i - 1, F.lit(1)).rlike(r"\w")))
    near = F.array_max(F.transform(begins, lambda i: 1 - F.levenshtein(F.substring(F.col("__t"), i, size), F.col("__q")) / size))
    exact = F.contains("__t", "__q") & (F.col("__q") != "")
    similarity = F.when(exact, 1.0).when(F.col("__t").isNull() | F.col("__q").isNull() | (size == 0), 0.0).otherwise(F.coalesce(F.greatest(near, F.lit(0.0)), F.lit(0.0)))
    return joined.withColumn("similarity", F.round(similarity, 6)).withColumn("verified", F.col("similarity") >= least).drop("__c", "__t", "__q")


def demote_unverified(assertions: DataFrame, checked: DataFrame) -> DataFrame:
    """An assertion none of whose quotes is verified becomes inferred."""
    ok = checked.groupBy(F.col("assertion_id").alias("__a")).agg(F.max("verified").alias("__ok"))
    joined = assertions.join(ok, assertions["id"] == F.col("__a"), "left")
    good = F.coalesce("__ok", F.lit(False))
    return joined.withColumn("modality", F.when(good, F.col("modality")).otherwise("inferred")).withColumn("confidence", F.when(good, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.99)))).withColumn("verified", good).drop("__a", "__ok")


def invalidation(events: DataFrame, facts: DataFrame, assertion_id: str, at: str, reason: str, by: str | None = None) -> DataFrame:
    """The event to append; an unknown id, a second time or a strange reason is an error."""
    if reason not in REASONS:
        raise LedgerError(f"unknown reason {reason!r}")
    if facts.where(F.col("id") == assertion_id).isEmpty():
        raise NotFound(f"no assertion {assertion_id}")
    if not events.where(F.col("assertion_id") == assertion_id).isEmpty():
        raise LedgerError(f"{assertion_id} has been invalidated before")
    known = by is not None and not facts.where(F.col("id") == by).isEmpty()
    row = [(assertion_id, at, reason, by if known else None)]
    return facts.sparkSession.createDataFrame(row, "assertion_id string, invalid_at string, invalidation_reason string, invalidated_by string").withColumn("invalid_at", F.to_timestamp("invalid_at"))


def state(facts: DataFrame, invalidations: DataFrame, disputes: DataFrame | None = None) -> DataFrame:
    """Facts with invalid_at, invalidation_reason and status."""
    first = invalidations.groupBy(F.col("assertion_id").alias("__i")).agg(F.min(F.struct("invalid_at", "invalidation_reason", "invalidated_by")).alias("__e"))
    out = facts.join(first, facts["id"] == F.col("__i"), "left").select(facts["*"], F.col("__e.invalid_at").alias("invalid_at"), F.col("__e.invalidation_reason").alias("invalidation_reason"), F.col("__e.invalidated_by").alias("invalidated_by"))
    disputed = F.lit(False)
    if disputes is not None:
        both = disputes.select(F.explode(F.array("a", "b")).alias("__x")).distinct()
        out = out.join(both, out["id"] == F.col("__x"), "left")
        disputed = F.col("__x").isNotNull()
    status = F.when(F.col("invalid_at").isNotNull(), "invalidated").when(disputed, "disputed").otherwise("active")
    return out.withColumn("status", status).drop("__x")


def active(view: DataFrame, predicate: str | None = None, subject: str | None = None) -> DataFrame:
    out = view.where("invalid_at IS NULL")
    if predicate is not None:
        out = out.where(F.col("predicate") == predicate)
    return out if subject is None else out.where(F.col("subject_id") == subject)


def as_of(view: DataFrame, at: object, predicate: str | None = None, subject: str | None = None) -> DataFrame:
    """What was believed at a time."""
    t = F.lit(at).cast("timestamp")
    out = view.where((F.col("asserted_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)))
    if predicate is not None:
        out = out.where(F.col("predicate") == predicate)
    return out if subject is None else out.where(F.col("subject_id") == subject)


def valid_on(view: DataFrame, day: object) -> DataFrame:
    """What holds in the world on a day."""
    d = F.lit(day).cast("date")
    return view.where((F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d)))


def as_of_many(view: DataFrame, dates: DataFrame, at: str = "at", slots: int = 16) -> DataFrame:
    """(date, row) for many dates: an interval join by counting, not a product.

    The dates are cut into ``slots`` ranges of equal time; each fact goes to the
    ranges its interval meets, and joins the dates of those ranges by equality."""
    span = dates.agg(F.min(at).cast("double").alias("lo"), F.max(at).cast("double").alias("hi"))
    slot = lambda c: F.floor((c.cast("double") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * (slots - 1)).cast("int")
    d = dates.select(at).distinct().crossJoin(F.broadcast(span)).select(F.col(at), slot(F.col(at)).alias("__slot"))
    end = F.coalesce("invalid_at", F.lit("9999-12-31").cast("timestamp"))
    a = view.crossJoin(F.broadcast(span)).where((F.col("asserted_at").cast("double") <= F.col("hi")) & (end.cast("double") >= F.col("lo")))
    first, last = F.greatest(slot(F.col("asserted_at")), F.lit(0)), F.least(slot(F.least(end, F.to_timestamp(F.timestamp_seconds("hi")))), F.lit(slots - 1))
    a = a.withColumn("__s", F.explode(F.sequence(first, last))).drop("lo", "hi")
    hit = (F.col("__s") == F.col("__slot")) & (F.col("asserted_at") <= F.col(at)) & (end > F.col(at))
    return a.join(d, hit).drop("__s", "__slot")


def reconcile(new: DataFrame, held: DataFrame) -> DataFrame:
    """(subject_id, predicate, object, kind, prior_object) of new claims against
    the open ones, by equality of subject and predicate.

    ``held`` has one row a subject and predicate.  Completion and ownership are
    predicates ``status`` to ``complete`` and ``owner``."""
    h = held.select(F.col("subject_id").alias("hs"), F.col("predicate").alias("hp"), F.col("object").alias("prior_object"), F.col("asserted_at").alias("prior_at"))
    same = F.col("object").eqNullSafe(F.col("prior_object"))
    kind = (
        F.when(F.col("hs").isNull(), "new")
        .when(same, "confirmed")
        .when((F.col("predicate") == "status") & (F.col("object") == "complete"), "action_completed")
        .when((F.col("predicate") == "owner") & F.col("prior_object").isNull(), "owner_changed")
        .when(F.col("asserted_at") > F.col("prior_at"), "outdated")
        .otherwise("contradicted")
    )
    joined = new.join(h, (new["subject_id"] == F.col("hs")) & (new["predicate"] == F.col("hp")), "left")
    return joined.withColumn("kind", kind).drop("hs", "hp")


def change_report(changes: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts of each kind in a run; confirmations are only counted, of the others
    the subjects are listed."""
    others = F.collect_set(F.when(F.col("kind") != "confirmed", F.col("subject_id").cast("string")))
    return changes.groupBy(run, "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(others), ",").alias("subjects"))


def stale_after(view: DataFrame, days: dict[str, int], default: int = 180) -> DataFrame:
    """stale_after: valid_to if there is one, else the assertion's day plus the
    days of its document type."""
    plan = F.coalesce(*[F.when(F.col("doc_type") == t, F.lit(n)) for t, n in days.items()], F.lit(default))
    return view.withColumn("stale_after", F.coalesce(F.col("valid_to"), F.date_add(F.to_date("asserted_at"), plan)))


def run_cost(records: DataFrame, run: str | None = None) -> DataFrame:
    rows = records if run is None else records.where(F.col("run_id") == run)
    return rows.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def open_interval(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """Events as assertions that the next one of their key ends."""
    return events.withColumn("invalid_at", F.lead(at).over(Window.partitionBy(*key).orderBy(at, "event_id")))

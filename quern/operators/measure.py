"""Retrieval measurement: golden questions, ranking metrics, comparison of arms."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import tomllib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import GoldenError
from quern.functions import text
from quern.operators.sizes import hinted, union

SHAPES = ("lookup", "comparison", "temporal", "unanswerable")
KS = (5, 20)
GATE = {"questions": 40, "unanswerable": 7, "recall@20": 0.90}


def golden_from_toml(source: str) -> list[dict]:
    """Questions of a TOML file; every problem is reported at once."""
    problems, out, seen = [], [], set()
    try:
        data = tomllib.loads(source)
    except tomllib.TOMLDecodeError as e:
        raise GoldenError(f"not TOML: {e}") from e
    if "corpus_scale" not in data:
        problems.append("corpus_scale is missing")
    for i, q in enumerate(data.get("question", []), 1):
        name = q.get("id", f"#{i}")
        if name in seen:
            problems.append(f"{name}: the id is there twice")
        seen.add(name)
        if not str(q.get("question", "")).strip():
            problems.append(f"{name}: no question")
        if q.get("shape") not in SHAPES:
            problems.append(f"{name}: shape must be one of {', '.join(SHAPES)}")
        relevant = q.get("relevant", [])
        if q.get("answerable", True) != bool(relevant):
            problems.append(f"{name}: answerable and relevant disagree")
        for r in relevant:
            if not r.get("document") or not str(r.get("quote", "")).strip():
                problems.append(f"{name}: relevant needs document and quote")
        out.append({"question_id": name, "question": q.get("question"), "answerable": q.get("answerable", True), "shape": q.get("shape"), "relevant": relevant})
    if not out:
        problems.append("no questions")
    if problems:
        raise GoldenError("; ".join(problems))
    return out


def resolve_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id) of chunks of the named document that hold the quote.

    ``quotes``: question_id, document, quote; ``chunks``: id, document, text of
    current versions.  The join is on the document, so no product arises."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("document").alias("__d"), F.col("text").alias("__t"))
    return quotes.join(c, quotes["document"] == F.col("__d")).where(F.contains(F.col("__t"), F.col("quote"))).select("question_id", "chunk_id").distinct()


def resolve_anywhere(quotes: DataFrame, docs: DataFrame, quote_id: str, id_: str, quote: str = "text", body: str = "text") -> DataFrame:
    """(quote_id, id) of the documents that hold a quote as it is written.

    A quote's inner words, those with something before and after them, stand whole in
    every text that holds it; so the longest of them is joined with the texts' words
    and what meets is verified.  Only quotes without an inner word are sought in every
    text.  Null and empty quotes and null ids are in no row; repeats count once."""
    q = quotes.where(F.col(quote_id).isNotNull() & (F.col(quote) != "")).select(F.col(quote_id).alias("__q"), F.col(quote).alias("__quote"))
    words = F.regexp_extract_all("__quote", F.lit(rf"({text.WORD})"), F.lit(1))
    # the first and the last word may be parts of longer ones
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    q = q.withColumn("__w", longest)
    d = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("__d"), F.col(body).alias("__body"))
    own = d.select("__d", "__body", F.explode(F.array_distinct(F.regexp_extract_all("__body", F.lit(rf"({text.WORD})"), F.lit(1)))).alias("__own"))
    some = own.join(hinted(q.where("__w IS NOT NULL")), F.col("__own") == F.col("__w")).where(F.contains("__body", "__quote")).select("__q", "__d")
    short = q.where("__w IS NULL")
    if not short.isEmpty():
        some = union([some, d.join(hinted(short), F.contains("__body", "__quote")).select("__q", "__d")])
    return some.distinct().select(F.col("__q").alias(quote_id), F.col("__d").alias(id_))


def unresolved(quotes: DataFrame, resolved: DataFrame) -> DataFrame:
    r = resolved.select(F.col("question_id").alias("__q"))
    return quotes.join(r, quotes["question_id"] == F.col("__q"), "left_anti")


def require_resolved(quotes: DataFrame, resolved: DataFrame) -> None:
    left = [r[0] for r in unresolved(quotes, resolved).select("question_id").distinct().orderBy("question_id").limit(20).collect()]
    if left:
        raise GoldenError(f"no chunk holds the quotes of {', '.join(left)}")


def first_ranks(ranked: DataFrame, question: str, item: str) -> DataFrame:
    """Ranked lists without repeats, ranks made dense from 1."""
    once = ranked.groupBy(question, item).agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy("rank", item)))


def score(ranked: DataFrame, relevant: DataFrame, question: str = "question_id", item: str = "chunk_id", ks: tuple[int, ...] = KS, ndcg_k: int = 10) -> DataFrame:
    """recall@k, ndcg and reciprocal rank of every question with relevant items."""
    rel = relevant.select(question, item).distinct()
    total = rel.groupBy(F.col(question).alias("__q")).agg(F.count("*").alias("n"))
    r = first_ranks(ranked, question, item)
    hits = rel.join(r, [question, item])
    gain = F.when(F.col("rank") <= ndcg_k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    parts = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}") for k in ks]
    per = hits.groupBy(question).agg(*parts, F.sum(gain).alias("dcg"), F.min("rank").alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    joined = total.join(per, F.col("__q") == F.col(question), "left")
    cols = [F.round(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n"), 6).alias(f"recall_at_{k}") for k in ks]
    return joined.select(F.col("__q").alias(question), *cols, F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias(f"ndcg_at_{ndcg_k}"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("rr"))


def aggregate(scores: DataFrame, questions: int) -> DataFrame:
    """Macro means; questions without relevant items are only counted."""
    if questions == 0:
        raise GoldenError("no questions to average")
    means = [F.round(F.avg(c), 6).alias(c) for c in scores.columns[1:]]
    return scores.agg(F.count("*").alias("answerable"), *means).withColumn("unanswerable", F.lit(questions) - F.col("answerable"))


def compare_arms(arms: dict[str, DataFrame], relevant: DataFrame, question: str, item: str) -> DataFrame:
    made = []
    for name in sorted(arms):
        s = score(arms[name], relevant, question, item)
        made.append(s.agg(*[F.round(F.avg(c), 6).alias(c) for c in s.columns[1:]]).select(F.lit(name).alias("arm"), "*"))
    return union(made)


def provenance(settings: dict, counts: dict[str, int], model: str, folder: str = ".") -> dict:
    """What a measurement must carry; admissible only from a clean commit."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    commit, dirty = git("rev-parse", "HEAD"), git("status", "--porcelain")
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    return {"commit": commit, "dirty": bool(dirty), "settings": digest, "counts": counts, "model": model, "platform": platform.platform(), "admissible": bool(commit) and dirty == ""}

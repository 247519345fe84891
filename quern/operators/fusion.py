"""Reciprocal-rank fusion, reranking and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.sizes import union

RRF_K = 60


def fuse(arms: dict[str, DataFrame], query_id: str, id_: str, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """(query, id, score, ranks, rank) of ranked arms (query, id, rank).

    score is the sum of 1 / (k + rank); an id that an arm repeats counts once, at
    its best rank; ties go to the smaller id; the limit comes after fusing."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    if not arms:
        raise ValueError("no arm to fuse")
    rows = union([arms[n].select(query_id, id_, F.col("rank").cast("int").alias("r"), F.lit(n).alias("arm")) for n in sorted(arms)])
    rows = rows.groupBy(query_id, id_, "arm").agg(F.min("r").alias("r"))
    ranks = F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", "r"))))
    # summed in the arms' order, so that equal ranks give equal scores
    score = F.aggregate(F.transform(F.sort_array(F.collect_list("r")), lambda r: 1.0 / (k + r)), F.lit(0.0), lambda a, b: a + b)
    fused = rows.groupBy(query_id, id_).agg(F.round(score, 9).alias("score"), ranks.alias("ranks"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_)
    out = fused.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)


def overlap_rerank(hits: DataFrame, query_id: str, id_: str, query: str, body: str) -> DataFrame:
    """Adds rerank_score and rerank: the share of the query's distinct words in
    the body; ties keep the order of ``rank``."""
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"\s+"), ""))
    q = tokens(query)
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(body))) / F.size(q))
    order = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), "rank", id_)
    return hits.withColumn("rerank_score", F.round(share, 6)).withColumn("rerank", F.row_number().over(order))


def explain(hits: DataFrame, id_: str, body: str, heading_path: str | None = None) -> DataFrame:
    """score to 6 places, ranks as text, joined headings, a preview of 160 characters."""
    path = F.concat_ws(" > ", heading_path) if heading_path else F.lit("")
    shown = F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    preview = F.substring(F.regexp_replace(body, r"\s+", " "), 1, 160)
    return hits.select(*[c for c in hits.columns if c not in ("score", "ranks", body)], F.round("score", 6).alias("score"), shown.alias("ranks"), path.alias("heading_path"), preview.alias("preview"))


ARMS = ("dense", "headings", "sparse")


def check_arms(arms: tuple[str, ...]) -> tuple[str, ...]:
    unknown = sorted(set(arms) - set(ARMS))
    if unknown:
        raise ValueError(f"unknown arms: {', '.join(unknown)}; known: {', '.join(ARMS)}")
    return arms


__all__ = ["ARMS", "RRF_K", "check_arms", "explain", "fuse", "overlap_rerank", "text"]

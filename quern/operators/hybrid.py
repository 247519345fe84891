"""Hybrid search: dense, body and heading arms, fused, reranked or cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import dense, fusion, lexical
from quern.settings import Retrieval


def arms(chunks: DataFrame, id_: str, queries: DataFrame, query_id: str, body: str = "text", heading: str | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, settings: Retrieval = Retrieval(), names: tuple[str, ...] = fusion.ARMS) -> dict[str, DataFrame]:
    """The ranked lists (query, id, score, rank) of the arms asked for.

    ``vectors`` (id, embedding) and ``query_vectors`` (query, embedding); without
    them the dense arm is left out, and without ``heading`` that arm."""
    fusion.check_arms(names)
    out = {}
    if "dense" in names and vectors is not None and query_vectors is not None:
        out["dense"] = dense.nearest_batch(vectors, id_, "embedding", query_vectors, query_id, "embedding", settings.dense_k)
    if "headings" in names and heading is not None:
        out["headings"] = lexical.search(chunks, id_, heading, queries, query_id, settings.sparse_k)
    if "sparse" in names:
        out["sparse"] = lexical.search(chunks, id_, body, queries, query_id, settings.sparse_k)
    return out


def search(ranked: dict[str, DataFrame], query_id: str, id_: str, k: int | None = None, settings: Retrieval = Retrieval()) -> DataFrame:
    """(query, id, score, ranks, rank): fused lists, cut to ``k`` (rerank_to)."""
    fused = fusion.fuse({n: a.select(query_id, id_, "rank") for n, a in ranked.items()}, query_id, id_, settings.fuse_to, settings.rrf_k)
    return fused.where(F.col("rank") <= (settings.rerank_to if k is None else k))


def reranked(ranked: dict[str, DataFrame], chunks: DataFrame, queries: DataFrame, query_id: str, id_: str, body: str = "text", k: int | None = None, settings: Retrieval = Retrieval()) -> DataFrame:
    """Fused lists of fuse_to, reordered by shared words and cut to ``k``."""
    fused = fusion.fuse({n: a.select(query_id, id_, "rank") for n, a in ranked.items()}, query_id, id_, settings.fuse_to, settings.rrf_k)
    bodies = chunks.select(F.col(id_).alias("__c"), F.col(body).alias("__body"))
    asked = queries.select(F.col(query_id).alias("__q"), F.col("text").alias("__query"))
    joined = fused.join(bodies, fused[id_] == F.col("__c")).join(asked, fused[query_id] == F.col("__q"))
    out = fusion.overlap_rerank(joined, query_id, id_, "__query", "__body").drop("__c", "__q", "__body", "__query")
    return out.where(F.col("rerank") <= (settings.rerank_to if k is None else k))

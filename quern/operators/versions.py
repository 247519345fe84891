"""Versions, duplicates and refresh.

Nothing is updated in place: a document is its observations, a version's
successor is the next by number, and what is current follows from windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(c: Column | str) -> Column:
    return F.sha2(c, 256)


def exact_duplicates(df: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, first id, copies) of every value that occurs more than once."""
    return df.groupBy(key).agg(F.min(id_).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def number_versions(df: DataFrame, document: str, order: str) -> DataFrame:
    """version_no from 1 for each document."""
    return df.withColumn("version_no", F.row_number().over(Window.partitionBy(document).orderBy(order)))


def supersede(df: DataFrame, document: str, id_: str, number: str = "version_no") -> DataFrame:
    """superseded_by: the id of the next version."""
    return df.withColumn("superseded_by", F.lead(id_).over(Window.partitionBy(document).orderBy(number)))


def latest(df: DataFrame, key: list[str] | str, order: list[Column] | str) -> DataFrame:
    """The last row of each key."""
    keys, orders = [key] if isinstance(key, str) else key, [F.desc(order)] if isinstance(order, str) else order
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))).where("__r = 1").drop("__r")


def next_version(versions: DataFrame, documents: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, next_no): one above the last, 1 if there is none."""
    last = versions.groupBy(F.col(document).alias("__d")).agg(F.max("version_no").alias("__m"))
    return documents.join(last, documents[document] == F.col("__d"), "left").select(document, (F.coalesce("__m", F.lit(0)) + 1).alias("next_no"))


def unseen(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming (document_id, content_hash) rows that differ from the current
    version: a return to an earlier content is a new version."""
    now = current.select(F.col("document_id").alias("__d"), F.col("content_hash").alias("__h"))
    return incoming.join(now, (incoming["document_id"] == F.col("__d")) & (incoming["content_hash"] == F.col("__h")), "left_anti")


def classify_refresh(before: DataFrame, after: DataFrame, key: str = "external_id", hash_: str = "content_hash") -> DataFrame:
    """(key, state): new, disappeared, unchanged or modified."""
    a = before.select(F.col(key).alias("ka"), F.col(hash_).alias("ha"))
    b = after.select(F.col(key).alias("kb"), F.col(hash_).alias("hb"))
    state = F.when(F.col("ka").isNull(), "new").when(F.col("kb").isNull(), "disappeared").when(F.col("ha").eqNullSafe(F.col("hb")), "unchanged").otherwise("modified")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), state.alias("state"))


def current_only(chunks: DataFrame, versions: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Chunks of current versions: the scope of every search."""
    if include_superseded:
        return chunks
    open_ = versions.where("superseded_by IS NULL").select(F.col("id").alias("__v"))
    return chunks.join(open_, chunks["version_id"] == F.col("__v"), "left_semi")


def with_headers(chunks: DataFrame, headers: DataFrame) -> DataFrame:
    """``body``: the latest header of a chunk, a blank line and its text; both
    search arms read it."""
    last = latest(headers, "chunk_id", [F.desc("set_at"), F.desc("header")]).select(F.col("chunk_id").alias("__c"), F.col("header").alias("__h"))
    body = F.concat(F.coalesce("__h", F.lit("")), F.lit("\n\n"), "text")
    return chunks.join(last, chunks["id"] == F.col("__c"), "left").withColumn("body", body).drop("__c", "__h")

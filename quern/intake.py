"""From files to searchable chunks: scan, expand, hash, parse, sanitise, version, chunk.

Only contents that differ from a document's current version are parsed.  What is
parsed is written once and read from there on, so no file is parsed twice; its files and
those of the chunks are then moved into their tables.  Contents are shuffled once, to
find what differs, and not at all in an empty store, unless they lie in fewer
partitions than there are cores.  Texts are never shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalog import TABLES, Catalog
from quern.errors import BudgetExceeded, EmbeddingMismatch
from quern.functions import embed as vectors
from quern.functions import metadata
from quern.operators import chunking, dense, fusion, hybrid, sizes, versions
from quern.operators.graph import cut
from quern.operators.sanitise import sanitise
from quern.settings import Settings, stamp
from quern.sources import files

#: Chunks whose vectors are committed at once.
COMMIT_ROWS = 1_000_000
#: Chunks that a run may embed for each document that it may take in.
CHUNKS_A_DOCUMENT = 200
#: Documents worth a task of their own, if cores are idle.
TASK = 1_000

QUARANTINE = "quarantine array<struct<start:int,end:int,reason:string,text:string>>"


def hashed_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 32)


def cleaned(parsed: DataFrame) -> DataFrame:
    """Parsed rows sanitised, with headings and pages moved along."""
    schema = T.StructType([*parsed.schema, *T._parse_datatype_string(QUARANTINE)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                if r["text"] is None:
                    rows.append({**r, "quarantine": []})
                    continue
                marks = [(h["start"], h["level"], h["text"]) for h in r["headings"]]
                c = sanitise(r["text"], marks, [int(o) for o in r["page_offsets"]], list(r["warnings"]))
                rows.append({**r, "text": c.text, "headings": [{"start": a, "level": n, "text": t} for a, n, t in c.headings], "page_offsets": c.page_offsets, "warnings": c.warnings, "quarantine": [{"start": s.start, "end": s.end, "reason": s.reason, "text": s.text} for s in c.quarantine]})
            yield pd.DataFrame(rows, columns=schema.names)

    return parsed.mapInPandas(run, schema)


def ingest_files(catalog: Catalog, found: DataFrame, workspace: str, settings: Settings = Settings()) -> DataFrame:
    """Ingest rows (external_id, uri, content, error); returns (external_id, outcome,
    reason), outcome being ingested, unchanged or failed.  Safe to repeat."""
    started = datetime.now(UTC)
    now, run_id = F.lit(started).cast("timestamp"), uuid.uuid4().hex
    staged = f"{catalog.folder}/_staged/{uuid.uuid4().hex}"
    given = found.withColumn("document_id", hashed_id(F.lit(workspace), F.col("external_id"))).withColumn("content_hash", versions.content_hash("content"))
    last = catalog.read("version").groupBy(F.col("document_id").alias("__d")).agg(F.max(F.struct("version_no", "content_hash")).alias("__v"))
    paired = given.where("error IS NULL").join(last, F.col("document_id") == F.col("__d"), "left")
    # a return to an earlier content is a new version
    same = F.coalesce(F.col("content_hash") == F.col("__v.content_hash"), F.lit(False))
    fresh = paired.where(~same)
    n = fresh.limit(settings.budget.max_docs_per_run + 1).count()
    if n > settings.budget.max_docs_per_run:
        raise BudgetExceeded(f"more than {settings.budget.max_docs_per_run} documents in one run")
    fresh = fresh.withColumn("version_no", F.coalesce("__v.version_no", F.lit(0)) + 1).withColumn("bytes", F.octet_length("content").cast("long"))
    fresh = sizes.dealt(fresh, found.rdd.getNumPartitions(), n, TASK)
    rows = cleaned(files.parsed(fresh, ("uri", "document_id", "version_no", "content_hash", "bytes")))
    heading = F.get(F.col("headings"), F.lit(0))["text"]
    title = metadata.title(F.col("title"), heading, F.col("external_id"))
    fields = {
        "title": title, "published_at": metadata.published_at(F.try_to_date(F.col("published_at"), "yyyy-MM-dd"), F.col("external_id"), F.col("text")),
        "doc_type": metadata.doc_type(F.col("external_id"), title, F.col("text"), settings.profile.doc_types), "meeting_or_project": metadata.meeting(title, F.col("text")), "uri": F.col("uri"),
    }
    described = rows.select(hashed_id(F.col("document_id"), F.col("version_no"), F.col("content_hash")).alias("id"), "document_id", "version_no", "external_id", "content_hash", F.sha2("text", 256).alias("text_hash"), "mime", "bytes", "parser", F.col("quality").alias("parse_quality"), now.alias("ingested_at"), "text", "warnings", "headings", "page_offsets", "quarantine", "authors", "error", F.col("error").isNotNull().alias("failed"), *[c.alias(k) for k, c in fields.items()])
    # the version table's files to be, with all that other tables take from them
    taken = catalog.stage(f"{staged}/taken", described.withColumn("misses", metadata.misses({k: F.col(k) for k in fields})), ["failed"])
    good = taken.where("NOT failed")
    catalog.append("document", good.select(F.col("document_id").alias("id"), F.lit(workspace).alias("workspace_id"), "external_id", "uri", "title", "doc_type", "meeting_or_project", "published_at", "authors", now.alias("observed_at")))
    spans = good.select(F.col("id").alias("version_id"), F.inline("quarantine"))
    catalog.append("quarantine", spans.select(hashed_id(F.col("version_id"), F.col("start"), F.col("end"), F.col("reason")).alias("id"), "version_id", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "text", "reason"))
    limits = chunking.Limits(settings.chunking.max_tokens, settings.chunking.overlap, settings.chunking.structure_first)
    made = chunking.chunk_versions(good.select("id", "text", "headings", "page_offsets"), headings="headings", pages="page_offsets", limits=limits)
    chunks = catalog.stage(f"{staged}/chunks", made.withColumn("id", hashed_id(F.col("version_id"), F.col("ordinal"))).withColumn("workspace_id", F.lit(workspace)))
    fields = {"body": F.col("text"), "heading": F.concat_ws(" ", "heading_path")}
    for field, column in fields.items():
        catalog.index_texts(chunks.select(F.col("id").alias("chunk_id"), F.lit(field).alias("field"), column.alias("text")))
    catalog.adopt("chunk", f"{staged}/chunks")
    refused = given.where("error IS NOT NULL").select("external_id", F.lit("failed").alias("outcome"), F.col("error").alias("reason"))
    unchanged = paired.where(same).select("external_id", F.lit("unchanged").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    done = taken.select("external_id", F.when(F.col("failed"), "failed").otherwise("ingested").alias("outcome"), F.col("error").alias("reason"), "id", "document_id", "version_no")
    rest = sizes.union([refused, unchanged]).select("*", *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("id", "document_id", "version_no")])
    told = catalog.stage(f"{staged}/outcomes", sizes.union([done, rest]))
    # a version is there last: until then a repeated run takes its document as new
    catalog.adopt("version", f"{staged}/taken/failed=false")
    # a document's first version is news, a later one a change of what was known
    kind = F.when(F.col("version_no") == 1, "new").otherwise("outdated")
    events = told.where("outcome = 'ingested'").select(hashed_id(F.lit(run_id), F.col("id")).alias("id"), F.lit(run_id).alias("run_id"), kind.alias("kind"), F.col("document_id").alias("subject_id"), F.monotonically_increasing_id().alias("seq"))
    catalog.append("change_event", events)
    outcomes = told.select("external_id", "outcome", "reason")
    counted = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    row = [(run_id, workspace, started, datetime.now(UTC), counted)]
    catalog.append("run", catalog.spark.createDataFrame(row, TABLES["run"]))
    return outcomes


def ingest(catalog: Catalog, target: str, workspace: str, settings: Settings = Settings()) -> DataFrame:
    return ingest_files(catalog, files.expanded(files.scan(catalog.spark, target)), workspace, settings)


def index(catalog: Catalog, workspace: str, embedder: vectors.Embedder, rebuild: bool = False, settings: Settings | None = None, commit_rows: int = COMMIT_ROWS) -> int:
    """Vectors for the chunks that have none; how many.

    Chunks are committed in parts of about ``commit_rows``, so a run that is broken off
    is gone on with from the last part.  With ``settings``, an embedder of another width
    than they say and more than 200 chunks for each document allowed are refused before
    anything is written."""
    if settings is not None and embedder.dimensions != settings.embeddings.dimensions:
        raise EmbeddingMismatch(f"{embedder.name} is {embedder.dimensions} wide, the settings say {settings.embeddings.dimensions}")
    mine = catalog.chunks().where(F.col("workspace_id") == workspace)
    last = catalog.space(workspace)
    held = last is not None and last.vectors > 0
    record = rebuild or last is None or dense.guard_space(catalog.read("embedding_space").where(F.col("generation") == last.generation), workspace, embedder.name, embedder.dimensions, held)
    generation = uuid.uuid4().hex if record else last.generation
    todo = dense.missing(mine, catalog.read("embedding").where(F.col("generation") == generation))
    n = todo.count()
    if n == 0:
        return 0
    if settings is not None and n > settings.budget.max_docs_per_run * CHUNKS_A_DOCUMENT:
        raise BudgetExceeded(f"{n} chunks, more than one run may embed")
    if record:
        catalog.record_space(workspace, embedder.name, embedder.dimensions, generation)
    parts = -(-n // commit_rows)
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    todo = cut(todo.select("id", "body")) if parts > 1 else todo
    for k in range(parts):
        catalog.append("embedding", vectors.embed(todo.where(part == k), embedder).withColumn("generation", F.lit(generation)))
    return n


def search(catalog: Catalog, queries: DataFrame, embedder: vectors.Embedder | None, settings: Settings = Settings(), arms: tuple[str, ...] = ("dense", "headings", "sparse"), k: int | None = None) -> DataFrame:
    """Hybrid search for rows (query_id, text): chunks with scores and ranks."""
    chunks = catalog.chunks()
    stored = asked = None
    if embedder is not None and "dense" in arms:
        stored = catalog.embeddings().select(F.col("chunk_id").alias("id"), "embedding").join(chunks.select("id"), "id", "left_semi")
        asked = vectors.embed(queries, embedder, "query_id", "text").withColumnRenamed("chunk_id", "query_id")
    ranked = hybrid.arms(chunks, "id", queries, "query_id", "body", None, stored, asked, settings.retrieval, tuple(a for a in fusion.check_arms(arms) if a == "dense"))
    for arm, field in (("headings", "heading"), ("sparse", "body")):
        if arm in arms:
            ranked[arm] = catalog.bm25(field, queries, "query_id", settings.retrieval.sparse_k, chunks.select("id")).withColumnRenamed("chunk_id", "id")
    found = hybrid.search(ranked, "query_id", "id", k, settings.retrieval)
    told = chunks.select(F.col("id").alias("__c"), "version_id", F.col("heading_path"), "page_from", "text")
    return found.join(told, F.col("id") == F.col("__c")).drop("__c")


def drift(catalog: Catalog, settings: Settings) -> list[str]:
    """Settings that differ from those the store was made with."""
    old, new = catalog.stamp(), stamp(settings)
    return sorted(f"{s}.{k}" for s in new for k in new[s] if str(old.get(s, {}).get(k)) != str(list(new[s][k]) if isinstance(new[s][k], tuple) else new[s][k]))

"""Tables under one folder: append-only Parquet, and the views that are read.

Nothing is updated in place.  What is current follows from windows over what
was appended; ids are hashes of their contents, so a repeated append is harmless
to every view."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ConfigError
from quern.functions import stem
from quern.operators import graph, ledger, lexical, versions
from quern.operators.sizes import hinted

FORMAT = 2
TABLES = {
    "document": "id string, workspace_id string, external_id string, uri string, title string, doc_type string, meeting_or_project string, published_at date, authors array<string>, observed_at timestamp",
    "version": "id string, document_id string, version_no int, content_hash string, text_hash string, mime string, bytes long, parser string, parse_quality double, ingested_at timestamp, text string, warnings array<string>, misses array<string>",
    "chunk": "id string, workspace_id string, version_id string, ordinal int, char_start int, char_end int, text string, heading_path array<string>, page_from int, page_to int, token_count int",
    "header": "chunk_id string, header string, set_at timestamp",
    "quarantine": "id string, version_id string, char_start int, char_end int, text string, reason string",
    "posting": "term string, chunk_id string, tf int, size int, field string, bucket int",
    "length": "chunk_id string, size int, field string",
    "embedding": "chunk_id string, embedding array<float>, generation string",
    "embedding_space": "workspace_id string, model string, dimensions int, generation string, recorded_at timestamp",
    "assertion": "id string, workspace_id string, subject_id string, predicate string, object string, modality string, confidence double, valid_from date, valid_to date, asserted_at timestamp, evidence array<struct<chunk_id:string,quote:string>>",
    "invalidation": "assertion_id string, invalid_at timestamp, invalidation_reason string, invalidated_by string",
    "dispute": "a string, b string",
    "entity": "id string, workspace_id string, type string, canonical_name string, normalised_name string, aliases array<string>, first_seen date, last_seen date, observed_at timestamp",
    "merge_event": "loser_id string, winner_id string, kind string, seq long, method string, score double",
    "run": "id string, workspace_id string, started_at timestamp, finished_at timestamp, outcomes map<string,long>",
    "change_event": "id string, run_id string, kind string, subject_id string, seq long",
    "run_record": "run_id string, stage string, model string, cost_usd double, duration_ms long",
}


#: Columns that a table's files are parted by.
PARTED = {"posting": ["field", "bucket"], "length": ["field"]}
#: Texts that a task indexes at least, as each task makes files of its own.
TASK = 2_000
#: Files that a task of a parted write keeps open at most, and bytes that each holds back.
OPEN_FILES, HELD = 64, 8 << 20


@contextmanager
def _open_files(spark: SparkSession) -> Iterator[None]:
    """A parted write keeps a file open for each part; Spark would sort all rows first,
    and spill them."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def create(self, settings: dict) -> None:
        """An empty store with its format's number and the settings' stamp."""
        if self.exists("_format"):
            raise ConfigError(f"{self.folder} holds a store already")
        self.spark.createDataFrame([(FORMAT, json.dumps(settings, default=str))], "format int, settings string").coalesce(1).write.json(f"{self.folder}/_format")

    def stamp(self) -> dict:
        """The settings the store was made with; another format is an error."""
        if not self.exists("_format"):
            raise ConfigError(f"{self.folder} is not a store")
        row = self.spark.read.schema("format int, settings string").json(f"{self.folder}/_format").first()
        if row.format != FORMAT:
            raise ConfigError(f"the store has format {row.format}; this library reads {FORMAT}")
        return json.loads(row.settings)

    def append(self, name: str, df: DataFrame) -> None:
        fields = [f.name for f in self.empty(name).schema.fields]
        self._write(name, df.select(*fields))

    def _write(self, name: str, df: DataFrame) -> None:
        self._put(f"{self.folder}/{name}", df, PARTED.get(name, ()))

    def _put(self, folder: str, df: DataFrame, parts: Sequence[str] = ()) -> None:
        writer = df.write.mode("append").option("compression", "zstd")
        if parts:
            writer = writer.option("parquet.block.size", HELD).partitionBy(*parts)
        with _open_files(df.sparkSession):
            writer.parquet(folder)

    def stage(self, folder: str, df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
        """Rows written beside the tables, once, and read from there on; see ``adopt``."""
        self._put(folder, df, parts)
        schema = T.StructType([*[f for f in df.schema if f.name not in parts], *[df.schema[p] for p in parts]])
        return self.spark.read.schema(schema).parquet(folder)

    def adopt(self, name: str, folder: str) -> None:
        """Staged files become a table's: moved, not written again.  Parts and columns that
        the table has not are left out or not read there."""
        root = self._fs.makeQualified(self._path(folder))
        if not self._fs.exists(root):
            return
        found, at, made = self._fs.listFiles(root, True), len(root.toString()), set()
        while found.hasNext():
            path = found.next().getPath()
            *inner, file = path.toString()[at:].strip("/").split("/")
            if file.startswith(("_", ".")):
                continue
            to = "/".join([self.folder, name, *[p for p in inner if p.split("=")[0] in PARTED.get(name, ())]])
            if to not in made:
                self._fs.mkdirs(self._path(to))
                made.add(to)
            if not self._fs.rename(path, self._path(f"{to}/{file}")):
                raise OSError(f"{path.toString()} cannot be moved into {name}")

    def empty(self, name: str) -> DataFrame:
        # the limit tells the planner what it is: nothing is shuffled to be joined with it
        return self.spark.createDataFrame([], TABLES[name]).limit(0)

    def read(self, name: str) -> DataFrame:
        """All that was appended."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}") if self.exists(name) else self.empty(name)

    def find(self, name: str, id_: str) -> Row | None:
        """The row of an id in a table, the last one appended to ``document``; None if
        there is none."""
        own = (self.documents() if name == "document" else self.read(name)).where(F.col("id") == id_)
        return own.limit(1).first()

    def workspaces(self) -> DataFrame:
        """(workspace_id, documents, chunks) of what is current."""
        docs = self.documents().groupBy("workspace_id").agg(F.count("*").alias("documents"))
        chunks = self.chunks().groupBy("workspace_id").agg(F.count("*").alias("chunks"))
        return docs.join(chunks, "workspace_id", "left").select("workspace_id", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"))

    def documents(self) -> DataFrame:
        """The last observation of each document."""
        return versions.latest(self.read("document"), "id", [F.desc("observed_at"), F.desc("uri")])

    def all_versions(self) -> DataFrame:
        """Versions with the one that replaced each."""
        return versions.supersede(self.read("version").dropDuplicates(["id"]), "document_id", "id")

    def chunks(self, include_superseded: bool = False) -> DataFrame:
        """Chunks with ``body``: the scope of every search."""
        own = versions.current_only(self.read("chunk").dropDuplicates(["id"]), self.all_versions(), include_superseded)
        return versions.with_headers(own, self.read("header"))

    def spaces(self) -> DataFrame:
        """The last recorded space of each workspace, with its number of vectors; a
        cleared one has no model."""
        last = self.read("embedding_space").groupBy("workspace_id").agg(F.max_by(F.struct("model", "dimensions", "generation"), F.struct("recorded_at", "generation")).alias("s")).select("workspace_id", "s.*")
        n = self.read("embedding").groupBy(F.col("generation").alias("__g")).agg(F.count_distinct("chunk_id").alias("vectors"))
        return last.join(n, F.col("generation") == F.col("__g"), "left").select("workspace_id", "model", "dimensions", "generation", F.coalesce("vectors", F.lit(0)).alias("vectors"))

    def space(self, workspace: str) -> Row | None:
        """That of one workspace, unless it was cleared."""
        return self.spaces().where((F.col("workspace_id") == workspace) & F.col("model").isNotNull()).first()

    def record_space(self, workspace: str, model: str | None, dimensions: int | None, generation: str) -> None:
        row = [(workspace, model, dimensions, generation, datetime.now(UTC))]
        self.append("embedding_space", self.spark.createDataFrame(row, TABLES["embedding_space"]))

    def clear_embeddings(self, workspace: str) -> None:
        """From here on the workspace has no vectors and no space; nothing is deleted."""
        self.record_space(workspace, None, None, uuid.uuid4().hex)

    def embeddings(self) -> DataFrame:
        """Vectors of each workspace's last space; older generations are left alone."""
        return self.read("embedding").join(F.broadcast(self.spaces().select("generation")), "generation", "left_semi").dropDuplicates(["chunk_id"])

    def index_texts(self, texts: DataFrame) -> None:
        """Append the postings and lengths of rows (chunk_id, field, text).

        A posting lies in the folder of its field and its term's bucket.  Texts are counted
        once, and each task writes to every folder itself, so that no posting is shuffled;
        few texts are few tasks', so that their files are few."""
        staged = f"{self.folder}/_staged/{uuid.uuid4().hex}"
        few = texts.coalesce(max(1, -(-texts.count() // TASK)))
        index = stem.counted(few.select(F.struct("chunk_id", "field").alias("id"), "text"), "id", "text")
        own = F.struct(F.lit(None).cast("string").alias("terms"), F.lit(None).cast("int").alias("tfs"))
        rows = index.select("id.chunk_id", "id.field", "size", F.explode(F.concat(F.array(own), F.arrays_zip("terms", "tfs"))).alias("__p"))
        term = F.col("__p.terms")
        kind = F.when(term.isNull(), "length").otherwise("posting")
        bucket = F.when(term.isNull(), -1).otherwise(lexical.bucket(term))
        self._put(staged, rows.select(term.alias("term"), "chunk_id", F.col("__p.tfs").alias("tf"), "size", kind.alias("kind"), "field", bucket.alias("bucket")), ("kind", "field", "bucket"))
        for name in ("length", "posting"):
            self.adopt(name, f"{staged}/kind={name}")

    def bm25(self, field: str, queries: DataFrame, query_id: str, k: int, scope: DataFrame | None = None, column: str = "text") -> DataFrame:
        """(query, chunk_id, score, rank) from stored postings: only the buckets of the
        terms asked for are read; statistics come from all that was indexed, ``scope``
        says what may be found."""
        asked = graph.cut(lexical.query_terms(queries, query_id, column))
        # at most lexical.BUCKETS numbers
        buckets = [r[0] for r in asked.select(lexical.bucket(F.col("term"))).distinct().collect()]
        wanted = hinted(asked.select(F.col("term").alias("__u")).distinct())
        stored = self._stored("posting").where((F.col("field") == field) & F.col("bucket").isin(buckets))
        # a repeated append of a chunk's postings counts once
        posted = stored.join(wanted, F.col("term") == F.col("__u"), "left_semi")
        lengths = self._stored("length").where(F.col("field") == field).groupBy("chunk_id").agg(F.max("size").alias("size"))
        corpus = lengths.agg(F.count("*").alias("__docs"), F.avg("size").alias("__avg"))
        return lexical.stored(posted, corpus, asked, "chunk_id", query_id, k, scope)

    def _stored(self, name: str) -> DataFrame:
        """As ``read``, but chunk ids of any type."""
        return self.spark.read.parquet(f"{self.folder}/{name}") if self.exists(name) else self.empty(name)

    def assertions(self) -> DataFrame:
        return ledger.state(self.read("assertion").dropDuplicates(["id"]), self.read("invalidation"), self.read("dispute"))

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() for n in TABLES if self.exists(n)}

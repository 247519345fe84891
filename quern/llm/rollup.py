"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches.  A batch holds signed deltas of
documents: an insert adds a document's counts, a delete takes away what the
document has now, a revision does both.  Totals by source, language and
tokenizer version are the sums of all deltas, so they are additive and never
recomputed.  A batch is committed under its id by one rename that fails if the id
is there, so a batch is not applied again and of two at once only one is; a retried
commit changes nothing.  ``totals`` reads per-batch sums, not documents.  A commit
with deletes or revisions groups the deltas of its own documents only: files are
sorted by a hash of doc_id in ``BUCKETS`` values, so that a small batch skips most of
them, and ids that the batch does not name go before anything is grouped.  ``compact`` folds all deltas of a document into one.

Counts are exact (see tokencount), one row for each tokenizer version.

Defined cases: a null text counts 0 tokens and 0 characters, but one document;
null source or lang is a group of its own; an insert of a doc_id that is there
counts again as one more document (repeated rows too); a delete or revision of a
doc_id that is not there, or no longer, changes nothing; a null doc_id can be inserted, not
deleted; within a batch deletes and revisions refer to the state before it, and
of several changes to one doc_id each takes effect once for inserts, and one
takes away; a revision that repeats is taken once, its least text; an
empty batch commits and changes nothing; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokencount
from quern.llm.common import cut, hinted, map_rows, shared_dir

VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
#: Batches of inserts that a whole table comes in.
PARTS = 3
#: Values of the hash that a batch's deltas are sorted by.
BUCKETS = 256


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = tokencount.FOLDER) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_docs, n_tokens, n_chars) of each row and version."""
    fields = [docs.schema[c] for c in ("doc_id", "source", "lang")]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("tokenizer", T.StringType()), *[T.StructField(c, T.LongType()) for c in MEASURES]])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = tokencount.counter(folder, versions).count(batch.column(3))
        one = pa.array([1] * batch.num_rows, pa.int64())
        for name, n in zip(versions, got):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * batch.num_rows), one, pa.array(n), batch.column(4)], names=schema.names)

    return map_rows(docs.select("doc_id", "source", "lang", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n")), schema, run)


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(17)), F.lit(BUCKETS)).cast("int").alias("bucket")


class Rollup:
    """Committed batches under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, versions: tuple[str, ...] = VERSIONS, tokenizers: str = tokencount.FOLDER):
        self.spark, self.folder, self.versions, self.tokenizers = spark, folder, versions, tokenizers
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        self._moves = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _at(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def batches(self) -> list[str]:
        if not self._fs.exists(self._path(self._at("batches"))):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self._at("batches"))))

    def _all(self, part: str) -> DataFrame | None:
        done = self.batches()
        return self.spark.read.parquet(*[self._at("batches", b, part) for b in done]) if done else None

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, text), op one of insert, delete
        and revise; False if the batch was committed before."""
        if batch_id in self.batches():
            return False
        new = counted(changes.where("op = 'insert'"), self.versions, self.tokenizers)
        gone = changes.where("op IN ('delete', 'revise') AND doc_id IS NOT NULL").select("doc_id").distinct()
        held = self._all("deltas")
        if held is not None and not gone.isEmpty():
            gone = cut(gone)
            buckets = [r[0] for r in gone.select(_bucket("doc_id")).distinct().collect()]
            own = held.where(F.col("bucket").isin(buckets)).join(hinted(gone), "doc_id", "left_semi")
            now = cut(own.groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]).where("n_docs <> 0"))
            minus = now.select("doc_id", *GROUP, *[(-F.col(c)).alias(c) for c in MEASURES])
            ids = now.select("doc_id").distinct()
            # min of a struct folds repeats where they are
            least = F.min(F.struct("text", "source", "lang")).alias("r")
            revised = changes.where("op = 'revise'").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "r.*")
            new = new.unionByName(counted(revised, self.versions, self.tokenizers)).unionByName(minus)
        return self._commit(batch_id, new)

    def _commit(self, batch_id: str, deltas: DataFrame) -> bool:
        made = self._at("staged", uuid.uuid4().hex)
        deltas.withColumn("bucket", _bucket("doc_id")).sortWithinPartitions("bucket").write.parquet(f"{made}/deltas")
        written = self.spark.read.parquet(f"{made}/deltas")
        written.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]).write.parquet(f"{made}/sums")
        self._fs.mkdirs(self._path(self._at("batches")))
        try:
            # unlike FileSystem.rename, this fails where the target exists, and does not nest
            self._moves.rename(self._path(made), self._path(self._at("batches", batch_id)), self._no_options)
        except Py4JJavaError as e:
            self._fs.delete(self._path(made), True)
            if "FileAlreadyExists" not in str(e.java_exception.toString()):
                raise
            return False
        return True

    def compact(self) -> DataFrame:
        """One row a document, group and version: the sum of all its deltas, those of
        nothing left out.  Committed as the only batch of another folder, it stands
        for this one."""
        held = self._all("deltas")
        if held is None:
            raise ValueError("no batch has been committed")
        return held.groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]).where("n_docs <> 0")

    def totals(self) -> DataFrame:
        sums = self._all("sums")
        if sums is None:
            raise ValueError("no batch has been committed")
        return sums.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]).where("n_docs <> 0")


def changes_of(docs: DataFrame, parts: int = PARTS) -> list[DataFrame]:
    """Changes in batches after which the rollup holds ``docs``: every document is
    inserted, in an earlier edition (half its text, no language) where a revision
    follows; then one half of the ids is deleted and the other revised; then what
    was deleted is inserted anew.  Repeated ids are deleted and inserted, as a
    revision counts once; rows with a null id, which cannot be deleted, are only
    inserted."""
    columns = ["doc_id", "source", "lang", "text"]
    hashed = docs.select(*columns, F.xxhash64(F.col("doc_id").cast("string"), F.lit(13)).alias("__h"))
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__many")).count().where("count > 1").select("__many")
    hashed = hashed.join(hinted(cut(ids)), F.col("doc_id") == F.col("__many"), "left")
    revised = F.col("doc_id").isNotNull() & F.col("__many").isNull() & (F.pmod("__h", F.lit(2)) == 0)
    named = hashed.withColumn("__revised", revised).withColumn("__part", F.pmod(F.shiftright("__h", 8), F.lit(parts)))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))
    earlier = named.withColumn("lang", F.when(~F.col("__revised"), F.col("lang"))).withColumn("text", F.when(F.col("__revised"), half).otherwise(F.col("text")))
    op = lambda rows, name: rows.select(F.lit(name).alias("op"), *columns)
    batches = [op(earlier.where(F.col("__part") == k), "insert") for k in range(parts)]
    again = named.where("NOT __revised AND doc_id IS NOT NULL")
    gone = again.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in columns[1:]})
    batches.append(op(gone, "delete").unionByName(op(named.where("__revised"), "revise")))
    return [*batches, op(again, "insert")]


def totals_of(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, tokenizers: str = tokencount.FOLDER) -> DataFrame:
    """Commit the whole table by the batches of ``changes_of``, each once more as a
    retry would; the totals are those of ``docs``."""
    spark = docs.sparkSession
    store = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", versions, tokenizers)
    for k, changes in enumerate(changes_of(docs)):
        for _ in range(2):
            store.commit(f"documents-{k}", changes)
    return store.totals()

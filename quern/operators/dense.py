"""Dense search: exact cosine over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import EmbeddingMismatch
from quern.functions import vectors
from quern.operators.graph import cut
from quern.operators.lexical import top

#: Vectors a block: 8 MB at 512 places.
BLOCK = 2048


def check_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """The rows, of which one of another width fails the job."""
    ok = F.col(column).isNull() | (F.size(column) == width)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector is not {width} wide: "), F.size(column).cast("string")))))


def nearest(index: DataFrame, id_: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k nearest to one vector; a zero query has no neighbours."""
    if not any(query):
        return index.select(id_, F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.where(F.col(vector).isNotNull()).select(id_, F.round(vectors.cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def _blocks(df: DataFrame, id_: str, vector: str, rows: int) -> DataFrame:
    """(ids, n, m): up to ``rows`` vectors in one row, as float64 bytes."""
    kind = df.schema[id_].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                flat, n = part.column(1).flatten(), pc.unique(pc.list_value_length(part.column(1)))
                m = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(n) == 1 and not flat.null_count else np.array(part.column(1).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([m.tobytes()], pa.binary())], names=["ids", "m"])

    return df.where(F.col(vector).isNotNull() & F.col(id_).isNotNull()).select(id_, vector).mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("m", T.BinaryType())]))


def nearest_batch(index: DataFrame, id_: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, skip_self: bool = False, rows: int = BLOCK) -> DataFrame:
    """(query, id, score, rank): the k nearest of each query, exactly.

    Both sides are packed into blocks of vectors and every pair of blocks is one
    matrix product, of which only the k best of each query go on; so nothing is
    broadcast but by Spark's own choice, and what is shuffled is k rows a query
    and block, not a row a pair."""
    qid, iid = queries.schema[query_id].dataType, index.schema[id_].dataType
    # written, as a product reads one side again for every part of the other
    pairs = cut(_blocks(index, id_, vector, rows)).crossJoin(cut(_blocks(queries, query_id, query_vector, rows)).select(F.col("ids").alias("qids"), F.col("m").alias("q")))
    return top(_products(pairs.select("ids", "m", "qids", "q"), qid, iid, query_id, id_, k, skip_self), query_id, id_, k)


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """No more than the k-th largest of each row; of long rows the k-th largest of the
    maxima of groups, as k groups hold k that are as large."""
    groups = score.shape[1] // 16
    if groups >= 2 * k:
        score = score[:, : groups * 16].reshape(len(score), 16, groups).max(1)
    if score.shape[1] <= k:
        return np.full(len(score), -np.inf, np.float32)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def _products(pairs: DataFrame, qid: T.DataType, iid: T.DataType, query_id: str, id_: str, k: int, skip_self: bool) -> DataFrame:
    """(query, id, score): of each pair of blocks (ids, m, qids, q) the k best of a query."""
    schema = T.StructType([T.StructField(query_id, qid), T.StructField(id_, iid), T.StructField("score", T.DoubleType())])

    def unit(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(raw, np.float64).reshape(n, -1)
        size = np.sqrt((x * x).sum(1))
        return x, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, qids = batch.column(0)[r].values, batch.column(2)[r].values
                (x, nx), (q, nq) = unit(batch.column(1)[r].as_py(), len(ids)), unit(batch.column(3)[r].as_py(), len(qids))
                if x.shape[1] != q.shape[1]:
                    raise EmbeddingMismatch(f"vectors of {x.shape[1]} and {q.shape[1]} places")
                asked = np.flatnonzero(nq > 0)
                if not len(asked) or not len(x):
                    continue
                x, q = x / np.where(nx > 0, nx, 1.0)[:, None], q[asked] / nq[asked, None]
                # single precision finds who may be among the k best, double decides
                near = q.astype(np.float32) @ x.astype(np.float32).T
                if skip_self:
                    own = pc.index_in(qids.take(pa.array(asked)), value_set=(known := pc.unique(ids)))
                    if own.null_count < len(own):
                        mine = pc.index_in(ids, value_set=known).to_numpy(zero_copy_only=False)
                        near[own.fill_null(-1).to_numpy(zero_copy_only=False)[:, None] == mine[None, :]] = -np.inf
                least = _kth(near, k) - (1.5e-6 + 4e-7 * (x.shape[1] + 8))
                at, who = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                score = np.round(np.einsum("ij,ij->i", q[at], x[who]), 6)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(asked[at])), ids.take(pa.array(who)), pa.array(score)], names=schema.names)

    return pairs.mapInArrow(run, schema)


def centroids(index: DataFrame, id_: str, vector: str, lists: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``lists`` clusters, fitted on the ``sample`` vectors with the least
    hashes of their ids (a bound of the fit; every vector is indexed)."""
    some = index.where(F.col(vector).isNotNull() & F.col(id_).isNotNull()).select(vector, F.xxhash64(F.col(id_).cast("string"), F.lit(3)).alias("h")).orderBy("h").limit(sample).collect()
    if not some:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in some], np.float64)
    size = np.linalg.norm(x, axis=1)
    x = x[size > 0] / size[size > 0, None]
    if len(x) == 0:
        return np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.linalg.norm(sums, axis=1)
        c = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], c)
    return c


def nearest_clustered(index: DataFrame, id_: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, lists: int = 64, probes: int = 12, skip_self: bool = False, rows: int = BLOCK) -> DataFrame:
    """(query, id, score, rank): the k nearest among the vectors of the ``probes``
    clusters nearest to each query.  Every vector is in the list of its nearest centre;
    more probes raise recall, and all of them give the exact answer.  The centres, at
    most ``lists``, go to every executor; vectors and queries meet list by list, in
    blocks of ``rows`` vectors, by one matrix product each."""
    centres = centroids(index, id_, vector, lists)
    if len(centres) == 0:
        return nearest_batch(index.limit(0), id_, vector, queries, query_id, query_vector, k, skip_self, rows)

    def listed(df: DataFrame, key: str, column: str, most: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
                if x.shape[1] != centres.shape[1]:
                    raise EmbeddingMismatch(f"vectors of {x.shape[1]} and {centres.shape[1]} places")
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most]
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["list", key, column])

        own = df.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(key, column)
        return own.mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), own.schema[key], own.schema[column]]))

    def packed(df: DataFrame, key: str, column: str, names: tuple[str, str, str]) -> DataFrame:
        # a list is cut into parts of about ``rows``, so that a large one is no one task's
        parts = df.groupBy(F.col("list").alias("__l")).agg(F.ceil(F.count("*") / rows).alias("__n"))
        cut_ = df.join(parts, F.col("list") == F.col("__l")).withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("__n")))
        schema = T.StructType([T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.ArrayType(df.schema[key].dataType)), T.StructField(names[2], T.BinaryType())])

        def pack(t: pa.Table) -> pa.Table:
            m = np.array(t.column(column).to_pylist(), np.float64)
            return pa.table({names[0]: t.column("list").slice(0, 1), names[1]: pa.array([t.column(key).to_pylist()], pa.list_(t.column(key).type)), names[2]: pa.array([m.tobytes()], pa.binary())})

        return cut_.select("list", "part", key, column).groupBy("list", "part").applyInArrow(pack, schema)

    left = packed(listed(index, id_, vector, 1), id_, vector, ("list", "ids", "m"))
    right = packed(listed(queries, query_id, query_vector, probes), query_id, query_vector, ("qlist", "qids", "q"))
    pairs = left.join(right, F.col("list") == F.col("qlist")).select("ids", "m", "qids", "q")
    return top(_products(pairs, queries.schema[query_id].dataType, index.schema[id_].dataType, query_id, id_, k, skip_self), query_id, id_, k)


def missing(chunks: DataFrame, embedded: DataFrame, id_: str = "id", chunk_id: str = "chunk_id") -> DataFrame:
    """Chunks that have no vector yet: what an interrupted run goes on with."""
    have = embedded.select(F.col(chunk_id).alias("__e"))
    return chunks.join(have, chunks[id_] == F.col("__e"), "left_anti")


def guard_space(spaces: DataFrame, workspace: str, model: str, dimensions: int, has_vectors: bool) -> bool:
    """True if the space must be recorded; a differing one with vectors is an error."""
    known = spaces.where(F.col("workspace_id") == workspace).select("model", "dimensions").limit(1).collect()
    if known and tuple(known[0]) != (model, dimensions):
        if has_vectors:
            raise EmbeddingMismatch(f"the index holds {known[0][0]} ({known[0][1]}), not {model} ({dimensions}); rebuild it first")
        return True
    return not known

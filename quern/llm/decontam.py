"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if at least ``THRESHOLD`` of the item's
distinct shingles (runs of 5 words) are among the document's.  Items are short
and documents long, so the Jaccard similarity of the two is tiny and depends on
the sizes.  Hence both sides are partitioned by size: items into classes of
their number of shingles, documents into classes by powers of two.  For each
pair of classes a document is sketched by one-permutation MinHash, with as many
bins as its class's upper bound over the item class's load: the least hash of
each bin.  The load is the largest at which an item of the class that is just at
the threshold shares a bin's least hash with probability ``RECALL`` at least;
for the smallest items that is every shingle.  A shared value makes a candidate,
verified by exact containment over all the document's shingles.

If the items' shingles are few enough (``BROADCAST_SHINGLES``, checked by a
count), they go to every executor and documents are searched where they are,
without a shuffle; beyond that sketches are equality-joined and only candidates'
shingles are joined again.  Both ways give the same rows.

Defined cases: null or empty texts and items without words match nothing; an item
or a document under 5 words has its whole run of words as its one shingle;
repeated items or documents (rows with the same id) give one row a pair, with
the largest containment; a null id is never reported, but a document with a
null doc_id that holds an item is still dropped by ``drop``; other columns are
not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import textbytes
from quern.llm.common import cut, id_type, map_rows, without

WIDTH = 5
THRESHOLD = 0.7
RECALL = 0.995
BROADCAST_SHINGLES = 4_000_000


def distinct_shingles(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes) of each text."""
    raw, off = textbytes.buffers(column)
    for a, b in textbytes.slices(off):
        part, po = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, firsts = textbytes.word_spans(part, po)
        values, rows = textbytes.shingles(textbytes.word_hashes(part, starts, ends), firsts, width)
        for i in range(b - a):
            yield a + i, np.unique(values[rows[i] : rows[i + 1]])


def load(least: int, threshold: float, recall: float) -> float:
    """Shingles a bin may hold, so that an item of ``least`` shingles or more, of
    which the threshold's share is in the document, shares a bin's least hash
    with probability ``recall``; 0: every shingle must be in the sketch."""
    shared = math.ceil(threshold * least)
    need = 1 - (1 - recall) ** (1 / shared)
    if need > 0.8:
        return 0.0
    lo, hi = 1e-3, 1e3
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 - math.exp(-mid)) / mid >= need else (lo, mid)
    return lo


def item_class(n: int) -> int:
    """0 for 1 to 7 shingles, then one class for each doubling."""
    return max(0, n.bit_length() - 3)


def bits(n_doc: int, item_cls: int, threshold: float, recall: float) -> int:
    """log2 of the bins for a document's class and an item class; 64: all shingles."""
    each = load(1 if item_cls == 0 else 1 << (item_cls + 2), threshold, recall)
    if not each:
        return 64
    upper = 1 << max(0, (n_doc - 1).bit_length())
    return max(0, math.ceil(math.log2(max(1.0, upper / each))))


def sketch(shingles: np.ndarray, log_bins: int) -> np.ndarray:
    """The least hash of each bin; bins are the top bits of sorted hashes."""
    if log_bins >= 64 or len(shingles) < 2:
        return shingles
    if log_bins == 0:
        return shingles[:1]
    bins = shingles >> np.uint64(64 - log_bins)
    first = np.empty(len(shingles), bool)
    first[0] = True
    np.not_equal(bins[1:], bins[:-1], out=first[1:])
    return shingles[first]


class Index:
    """Items' shingles, sorted, with the items of each."""

    def __init__(self, ids: np.ndarray, lists: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(x) for x in lists], np.int64)
        self.classes = np.array([item_class(len(x)) for x in lists], np.int64)
        self.by_class = []
        flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(lists)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        for c in sorted(set(self.classes.tolist())):
            pick = self.classes[self.owner] == c
            seen = np.zeros(1 << 20, bool)
            seen[(self.flat[pick] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_class.append((c, self.flat[pick], self.owner[pick], seen))

    def _owners(self, flat: np.ndarray, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(flat, values, "left"), np.searchsorted(flat, values, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return owner[at]

    def search(self, shingles: np.ndarray, threshold: float, recall: float) -> list[tuple[int, int]]:
        """(item position, shared shingles) of the items found in a document."""
        found = []
        for c, flat, owner, seen in self.by_class:
            s = sketch(shingles, bits(len(shingles), c, threshold, recall))
            s = s[seen[(s & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            if len(s):
                candidates = np.unique(self._owners(flat, owner, s))
                if len(candidates):
                    own = self._owners(flat, owner, shingles[np.isin(shingles, flat)])
                    shared = np.bincount(own, minlength=len(self.ids))
                    found += [(int(k), int(shared[k])) for k in candidates if shared[k] >= threshold * self.sizes[k]]
        return found


def _item_rows(items: DataFrame, width: int) -> DataFrame:
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("h", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [(i, x) for i, x in distinct_shingles(batch.column(1), width) if len(x)]
        ids = batch.column(0).take(pa.array([i for i, _ in got], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([x.view(np.int64) for _, x in got], pa.list_(pa.int64()))], names=["item_id", "h"])

    return map_rows(items.where("item_id IS NOT NULL").select("item_id", "text"), schema, run)


def _collected(rows: DataFrame, limit: int) -> Index | None:
    """The index if the items' shingles are at most ``limit``."""
    total = rows.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    if total > limit:
        return None
    got = rows.toArrow()
    lists = [np.array(x, np.int64).view(np.uint64) for x in got.column("h").to_pylist()]
    return Index(np.arange(len(lists)), lists), got.column("item_id").combine_chunks()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) of every item found in a document."""
    rows = cut(_item_rows(items, width))
    got = _collected(rows, broadcast_shingles)
    schema = T.StructType([T.StructField("doc_id", id_type(docs)), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("containment", T.DoubleType()), T.StructField("n_shingles", T.LongType())])
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    if got is not None:
        index, ids = got

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at, which, share, n = [], [], [], []
            for i, s in distinct_shingles(batch.column(1), width):
                for k, shared in index.search(s, threshold, recall) if len(s) else ():
                    at.append(i)
                    which.append(k)
                    share.append(shared / int(index.sizes[k]))
                    n.append(int(index.sizes[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(which, pa.int64())), pa.array(share, pa.float64()), pa.array(n, pa.int64())], names=schema.names)

        found = map_rows(named, schema, run)
    else:
        found = _joined(named, rows, threshold, recall, width)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles")).alias("m")).select("doc_id", "item_id", F.round("m.containment", 6).alias("containment"), F.col("m.n_shingles").alias("n_shingles"))


def _joined(docs: DataFrame, items: DataFrame, threshold: float, recall: float, width: int) -> DataFrame:
    """The way for many items: sketches are joined, candidates verified by join."""
    # item_class: the number of binary digits less 3
    rank = F.greatest(F.lit(0), F.length(F.bin("n")) - 3)
    sized = cut(items.withColumn("n", F.size("h")).withColumn("cls", rank).withColumn("item_no", F.monotonically_increasing_id()))
    classes = [r[0] for r in sized.select("cls").distinct().collect()]  # at most one a doubling of an item's length
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("doc_no", T.LongType()), T.StructField("cls", T.IntegerType()), T.StructField("v", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, s in distinct_shingles(batch.column(1), width):
            for c in classes if len(s) else ():
                v = s if c < 0 else sketch(s, bits(len(s), c, threshold, recall))
                take = pa.array(np.full(len(v), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(np.full(len(v), c, np.int32)), pa.array(v.view(np.int64))], names=schema.names)

    numbered = docs.withColumn("doc_no", F.xxhash64("doc_id", "text"))
    sketches = map_rows(numbered, schema, run)
    values = sized.select("item_no", F.col("cls").alias("c"), F.explode("h").alias("w"))
    candidates = cut(sketches.join(values, (F.col("cls") == F.col("c")) & (F.col("v") == F.col("w"))).select("doc_id", "doc_no", "item_no").distinct())
    some = candidates.select(F.col("doc_no").alias("__no")).distinct()
    full = T.StructType([T.StructField("doc_no", T.LongType()), T.StructField("v", T.LongType())])

    def every(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, s in distinct_shingles(batch.column(1), width):
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(np.full(len(s), i))), pa.array(s.view(np.int64))], names=full.names)

    shingles = map_rows(numbered.join(some, F.col("doc_no") == F.col("__no"), "left_semi"), full, every).distinct()
    wanted = candidates.join(sized.select(F.col("item_no").alias("no"), F.explode("h").alias("w")), F.col("item_no") == F.col("no"))
    shared = wanted.join(shingles.select(F.col("doc_no").alias("dn"), "v"), (F.col("doc_no") == F.col("dn")) & (F.col("w") == F.col("v"))).groupBy("doc_id", "doc_no", "item_no").agg(F.count("*").alias("k"))
    out = shared.join(sized.select(F.col("item_no").alias("no"), "item_id", F.col("n").cast("long").alias("n_shingles")), F.col("item_no") == F.col("no"))
    return out.where(F.col("k") >= threshold * F.col("n_shingles")).select("doc_id", "item_id", (F.col("k") / F.col("n_shingles")).alias("containment"), "n_shingles")


def drop(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    rows = cut(_item_rows(items, width))
    got = _collected(rows, broadcast_shingles)
    if got is None:
        return without(docs, contaminated(docs, items, threshold, recall, width, broadcast_shingles).select("doc_id"))
    index, at = got[0], docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = np.ones(batch.num_rows, bool)
        for i, s in distinct_shingles(batch.column(at), width):
            keep[i] = not (len(s) and index.search(s, threshold, recall))
        yield batch.filter(pa.array(keep))

    return map_rows(docs, docs.schema, run)

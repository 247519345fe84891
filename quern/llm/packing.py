"""Best-fit packing of documents into sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on the
histogram of lengths, which has no more rows than the capacity whatever the
number of documents, and the plan is exact for all of them at once:

1. A text longer than the capacity is cut: full sequences, and a remainder.
2. Pieces above one third of the capacity are matched greedily: the longest with
   the longest that still fits, so a sequence holds two of them at most.
3. Other pieces, longest first, go to the sequence with the smallest gap that
   holds them (best fit), and to a new one if none does.

The plan is a list of runs: pieces of one length, by rank, to a range of
sequences.  Ranks come from (length, salt) windows plus the counts before; a length
has as many salts as its pieces need (``SALT_ROWS`` each), so that no task sorts all
pieces of a common length, however many there are.  Results do not depend on how the
table is partitioned.

Defined cases: rows of length 0 or null (null and empty texts) are not packed; a
null doc_id is packed like any other; repeated rows are separate documents; equal
lengths are ranked by salted doc_id, piece and source row order among equal rows
is immaterial; an empty table packs to no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokencount
from quern.llm.common import cut, id_type, map_rows

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
SALT_ROWS = 200_000

#: (length, first rank, pieces, first bin, pieces a bin, offset in the bin)
Run = tuple[int, int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of bins."""
    left = {s: n for s, n in histogram.items() if n > 0}
    done: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges of bins

    def place(s: int, n: int, first: int, each: int) -> None:
        nonlocal left
        runs.append((s, done[s], n, first, each, 0))
        done[s] += n
        left[s] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for i, s in enumerate(large):
        for t in (t for t in large[i:] if s + t <= capacity):
            if left[s] == 0:
                break
            n = left[s] // 2 if t == s else min(left[s], left[t])
            if n == 0:
                continue
            runs.append((s, done[s], n, bins, 1, 0))
            done[s] += n
            left[s] -= n
            runs.append((t, done[t], n, bins, 1, s))
            done[t] += n
            left[t] -= n
            gaps[capacity - s - t].append((bins, n))
            bins += n
        if n := left[s]:
            runs.append((s, done[s], n, bins, 1, 0))
            done[s] += n
            left[s] = 0
            gaps[capacity - s].append((bins, n))
            bins += n
    for s in sorted((s for s in left if 0 < 3 * s <= capacity), reverse=True):
        n = left[s]
        for gap in sorted(g for g in gaps if g >= s):
            each = gap // s
            while n and gaps[gap]:
                first, size = gaps[gap].pop()
                full = min(size, n // each)
                if full:
                    runs.append((s, done[s], full * each, first, each, capacity - gap))
                    done[s] += full * each
                    n -= full * each
                    gaps[gap - each * s].append((first, full))
                if full < size:
                    if n and n < each:
                        runs.append((s, done[s], n, first + full, n, capacity - gap))
                        done[s] += n
                        gaps[gap - n * s].append((first + full, 1))
                        full, n = full + 1, 0
                    if full < size:
                        gaps[gap].append((first + full, size - full))
            if not gaps[gap]:
                del gaps[gap]
            if not n:
                break
        if n:
            each = capacity // s
            full, rest = divmod(n, each)
            if full:
                runs.append((s, done[s], full * each, bins, each, 0))
                done[s] += full * each
                gaps[capacity - each * s].append((bins, full))
                bins += full
            if rest:
                runs.append((s, done[s], rest, bins, rest, 0))
                done[s] += rest
                gaps[capacity - rest * s].append((bins, 1))
                bins += 1
    return runs, bins


def lengths(docs: DataFrame, folder: str = tokencount.FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n): the tokens of each text."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs)), T.StructField("n", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokencount.counter(folder, (vocabulary,)).count(batch.column(1))[0])], names=schema.names)

    return map_rows(docs.select("doc_id", "text"), schema, run)


def pack(sized: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(bin_id, bin_offset, doc_id, piece, start, n_tokens) of a table doc_id, n."""
    whole = F.floor(F.col("n") / F.lit(capacity))
    rest = F.col("n") % capacity
    cuts = F.sequence(F.lit(0).cast("long"), whole - F.when(rest == 0, 1).otherwise(0))
    pieces = sized.where("n > 0").select("doc_id", "n", F.explode(cuts).alias("piece"))
    pieces = cut(pieces.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("size")))
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most capacity rows
    salts = {s: -(-n // salt_rows) for s, n in histogram.items() if n > salt_rows}
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece")
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for e in salts.items() for x in e]), F.col("size")), F.lit(1)) if salts else F.lit(1)
    pieces = pieces.withColumn("salt", F.pmod(hashed, many.cast("long")))
    base = np.cumsum([0, *(salts.get(s, 1) for s in range(capacity + 1))])
    before = np.zeros(int(base[-1]), np.int64)
    if salts:
        # a row for every salt_rows pieces and one for every length, in the driver
        for size, salt, n in pieces.where(F.col("size").isin(list(salts))).groupBy("size", "salt").count().collect():
            before[base[size] + salt] = n
        for s in salts:
            own = before[base[s] : base[s + 1]]
            own[1:], own[0] = np.cumsum(own[:-1]), 0
    runs = sorted(plan(histogram, capacity)[0])
    table = np.array(runs, np.int64).reshape(-1, 6)
    heads = table[:, 0] << 44 | table[:, 1]
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")))
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("bin_offset", T.LongType()), T.StructField("doc_id", id_type(sized)), *[T.StructField(c, T.LongType()) for c in ("piece", "start", "n_tokens")]])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        piece, size, salt, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
        rank = before[base[size] + salt] + r - 1
        k = np.searchsorted(heads, size << 44 | rank, side="right") - 1
        nth = rank - table[k, 1]
        made = (table[k, 3] + nth // table[k, 4], table[k, 5] + nth % table[k, 4] * size)
        yield pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1]), batch.column(0), pa.array(piece), pa.array(piece * capacity), pa.array(size)], names=schema.names)

    return map_rows(ranked.select("doc_id", "piece", "size", "salt", "r"), schema, run)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str = tokencount.FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(lengths(docs, folder, vocabulary), capacity)

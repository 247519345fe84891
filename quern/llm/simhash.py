"""SimHash near-duplicates by deletion-variant signatures.

A document's signature has 128 bits: each bit is the majority, over the
document's distinct words, of that bit of the words' hashes.  Two documents are
near duplicates if their signatures differ in at most ``MAX_DISTANCE`` = 15
bits.  The signature is cut into only 8 segments, fewer than the 16 that exact
segment matching would need: of 15 differing bits some segment has at most one.
So each segment is indexed as it is and with each one bit left out (a wildcard),
an equality join on these variants finds every pair, and the Hamming distance
verifies it.  A variant with a wildcard goes to the left side of the join if its
bit is 0 and to the right if it is 1, so a pair meets once per segment at most;
of several segments the first one counts.  Documents of one group are those
linked by pairs, directly or not; the least doc_id of a group stays.

The search is exact with regard to the distance: no bucket is capped.  A signature
knows which words a text has, not their order: texts of the same words in another
order are near duplicates.

Defined cases: a null doc_id is never grouped and never dropped; a text without
words (null and empty too) has no signature, and is a copy only of texts equal
to it, null as empty; rows that share a doc_id are one document, whose least
text stands for it, and dropping duplicates leaves one of them; ties cannot
arise, as the least doc_id stays; an empty table gives an empty result; other
columns are not read.  Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import textbytes
from quern.llm.common import cut, fresh, hinted, id_type, map_rows, stored, without

SEGMENTS = 8
MAX_DISTANCE = 15
_WORD = 64


def _cuts() -> list[tuple[int, int, int]]:
    """(half, shift, width) of each segment: four of 16 bits in either half."""
    width = 2 * _WORD // SEGMENTS
    return [(half, a, width) for half in (0, 1) for a in range(0, _WORD, width)]


CUTS = _cuts()


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 64 bits, other 64 bits, number of distinct words) of each text."""
    raw, off = textbytes.buffers(column)
    n = len(off) - 1
    out = np.zeros((n, 2), np.int64)
    words = np.zeros(n, np.int32)
    for a, b in textbytes.slices(off):
        part, po = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, firsts = textbytes.word_spans(part, po)
        hashes = textbytes.word_hashes(part, starts, ends)
        for i in range(b - a):
            u = np.unique(hashes[firsts[i] : firsts[i + 1]])
            words[a + i] = len(u)
            if len(u):
                both = np.empty((len(u), 2), np.uint64)
                both[:, 0] = u
                both[:, 1] = textbytes.mix64(u)
                ones = np.zeros(128, np.int64)
                for k in range(0, len(u), 1 << 16):
                    ones += np.unpackbits(both[k : k + (1 << 16)].view(np.uint8), axis=1).sum(0, dtype=np.int64)
                out[a + i] = np.packbits(2 * ones > len(u)).view(np.int64)
    return out[:, 0], out[:, 1], words


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo, words: the signature of each row with a doc_id."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs)), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("words", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hi, lo, words = signatures(batch.column(1))
        # a text without words is known by a hash of its bytes
        bare = np.flatnonzero(words == 0)
        if len(bare):
            raw, off = textbytes.buffers(batch.column(1))
            for i in bare:
                v = raw[off[i] : off[i + 1]].astype(np.uint64)
                h = textbytes.mix64((v + np.uint64(1)) * textbytes.mix64(np.arange(len(v), dtype=np.uint64)))
                hi[i], lo[i] = (int(x) for x in np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(h, initial=0)], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi), pa.array(lo), pa.array(words)], names=["doc_id", "hi", "lo", "words"])

    return map_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), schema, run)


def _field(half: int, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col("hi" if half == 0 else "lo"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _variants(bit: int) -> Column:
    """Index keys of one side: each segment as it is, and each segment without
    one bit where that bit is ``bit``.  A key names segment, wildcard and value,
    in one int."""
    keys = []
    for s, (half, shift, width) in enumerate(CUTS):
        value = _field(half, shift, width).cast("int")
        keys.append(value.bitwiseOR(F.lit(_tag(s, 0))))
        for i in range(width):
            here = F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1))
            masked = value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))
            keys.append(F.when(here == bit, masked.bitwiseOR(F.lit(_tag(s, i + 1)))))
    return F.explode(F.array_compact(F.array(*keys)))


def _tag(segment: int, wildcard: int) -> int:
    return (segment * 32 + wildcard) << 22


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near(sigs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b, distance), a < b, of distinct signatures id, hi, lo.

    Index rows carry the first half of the signature only.  No pair is farther
    apart in a half than in the whole, so what that half leaves of the joined
    pairs, a few, is looked up and verified in full."""
    if max_distance > 2 * SEGMENTS - 1:
        raise ValueError(f"{SEGMENTS} segments find distances up to {2 * SEGMENTS - 1}")
    left = sigs.select(F.col("id").alias("a"), F.col("hi").alias("hi_a"), _variants(0).alias("key_a"))
    right = sigs.select(F.col("id").alias("b"), F.col("hi").alias("hi_b"), _variants(1).alias("key_b"))
    # the first segment of that half that meets; 31 if none does
    met = F.lit(31)
    for s, (half, shift, width) in reversed(list(enumerate(CUTS))):
        if half == 0:
            x = F.shiftrightunsigned(F.col("hi_a").bitwiseXOR(F.col("hi_b")), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            met = F.when(F.bit_count(x) <= 1, s).otherwise(met)
    segment = F.shiftrightunsigned("key_a", 27)
    wildcard = F.shiftrightunsigned("key_a", 22).bitwiseAND(F.lit(31))
    once = (met == segment) | ((met == 31) & (segment >= sum(half == 0 for half, _, _ in CUTS)))
    on = (F.col("key_a") == F.col("key_b")) & (_bits("hi_a", "hi_b") <= max_distance) & once & ((wildcard > 0) | (F.col("a") < F.col("b")))
    some = left.join(right, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = sigs.select(F.col("id").alias("ia"), F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"))
    two = sigs.select(F.col("id").alias("ib"), F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"))
    whole = some.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib"))
    distance = _bits("hi_a", "hi_b") + _bits("lo_a", "lo_b")
    return whole.where(distance <= max_distance).select("a", "b", distance.alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable over edges (a, b).

    Each round every node points to its least neighbour, the pointers are followed
    to their ends, and the edges are contracted to these ends; those within one
    end go, so what is shuffled shrinks from round to round."""
    spark = edges.sparkSession
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while not left.isEmpty():
        # the greater end of an edge is never its component's least: it points down
        least = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        ends = stored(least.unionByName(left.select(F.col("a").alias("id")).distinct().join(least.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_anti").select("id", F.col("id").alias("root"))))
        moved = True
        while moved:
            far = ends.select(F.col("id").alias("i"), F.col("root").alias("far"))
            new = stored(ends.join(far, F.col("root") == F.col("i")).select("id", "root", "far"))
            moved = not new.where("far <> root").isEmpty()
            ends = new.select("id", F.col("far").alias("root"))
        to = lambda n: ends.select(F.col("id").alias(f"i{n}"), F.col("root").alias(f"r{n}"))  # noqa: B023, E731
        if labels is None:
            labels = ends
        else:
            old = labels.join(to(0), F.col("root") == F.col("i0"), "left").select("id", F.coalesce("r0", "root").alias("root"))
            labels = stored(old)
        moved_ends = left.join(to(1), F.col("a") == F.col("i1")).join(to(2), F.col("b") == F.col("i2")).where("r1 <> r2")
        left = stored(moved_ends.select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).distinct())
    return labels if labels is not None else spark.createDataFrame([], edges.select(F.col("a").alias("id"), F.col("a").alias("root")).schema)


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, kept_doc_id, distance) of each document that is a near duplicate
    and not the one that stays; distance is to the one that stays."""
    rows = cut(sign(docs).groupBy("doc_id").agg(F.min(F.struct("words", "hi", "lo")).alias("s")).select("doc_id", "s.words", "s.hi", "s.lo"))
    same = cut(rows.groupBy("words", "hi", "lo").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    # equal signatures are one node, whatever their number of words
    nodes = same.where("words > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"))
    root = components(near(nodes, max_distance))
    whole = rows.withColumn("bare", F.col("words") == 0)
    first = same.groupBy(F.col("hi").alias("h"), F.col("lo").alias("l"), (F.col("words") == 0).alias("e")).agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    roots = root.select(F.col("id").alias("node"), "root")
    linked = first.join(roots, (first["id"] == roots["node"]) & ~first["e"], "left").where("n > 1 OR root IS NOT NULL")
    linked = linked.select("h", "l", "e", F.coalesce("root", "id").alias("kept"))
    member = whole.join(linked, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("bare") == F.col("e"))).select("doc_id", "hi", "lo", "kept")
    kept = member.where("doc_id = kept").select(F.col("doc_id").alias("kept_doc_id"), F.col("hi").alias("hi_k"), F.col("lo").alias("lo_k"))
    out = member.where("doc_id <> kept").join(kept, F.col("kept") == F.col("kept_doc_id"))
    return out.select("doc_id", "kept_doc_id", (_bits("hi", "hi_k") + _bits("lo", "lo_k")).alias("distance"))


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group, all their columns kept."""
    left = without(docs, groups(docs, max_distance).select("doc_id"))
    key, rank = fresh(docs, "__again"), fresh(docs, "__rank")
    again = cut(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if again.isEmpty():
        return left
    few = hinted(again)
    once = left.join(few, left["doc_id"] == F.col(key), "left_anti")
    many = left.join(few, left["doc_id"] == F.col(key), "left_semi")
    order = [F.struct(F.coalesce("text", F.lit("")), *[F.col(c).cast("string") for c in docs.columns if c != "text"])]
    one = many.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(rank) == 1).drop(rank)
    return once.unionByName(one)

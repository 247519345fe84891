"""Language-model scoring with a probabilistic suffix tree.

Symbols are the lower-cased bytes of a text, with ``DEPTH`` boundary symbols (0)
before it.  Over the whole corpus every run of DEPTH + 1 symbols is counted,
which gives the next-symbol counts of every context up to DEPTH symbols.  A
context is retained if it is seen ``MIN_COUNT`` times at least and its
next-symbol distribution diverges from that of its suffix without the oldest
symbol: count times Kullback-Leibler divergence above ``GAIN`` nats for each
distinct next symbol.  Suffixes of retained contexts are retained.  No share of
the corpus is asked for, so the tree grows with what the corpus shows.
Distributions are smoothed towards those of their suffixes with ``WEIGHT``
pseudo-counts, the empty context's towards the uniform one.

A text of the corpus is scored by what the rest of the corpus shows: its own counts
are taken from those of each context and symbol (leave one out), so no text is likely
because it was learned itself.  Copies are other texts, and count.  Counts of the tree
are found once for each distinct run of a slice of texts, in the longest retained
suffix of its context; own counts at every depth come from one sort of the slice's
runs, newest symbol first.  ``score`` of texts that are not of the corpus takes nothing
away.  If the tree has at most ``BROADCAST_ROWS`` rows (counted first) it goes to every
executor and texts are scored where they are; beyond that the runs of texts are
joined with the tree, level by level.  Both ways give the same rows.

Defined cases: equal divergence is decided by the same test, there are no ties to
break, and which contexts are retained is not changed by leaving one text out; a
context that only the text itself shows leaves its symbols to the next shorter one; a
null or empty text has no symbols and null bits; a zero byte
counts as byte 1; rows are independent, repeated rows score and count twice; an
empty table gives no rows; a null doc_id is scored like any other; other columns
are not read.  Whole texts are counted and scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import textbytes
from quern.llm.common import cut, id_type, map_rows, tune

DEPTH = 5
MIN_COUNT = 50
GAIN = 3.0
WEIGHT = 8.0
UNIFORM = 0.5
#: Distinct runs that a task holds before it hands them on.
HELD = 4_000_000
#: Rows that are scored at once: their numbers and six symbols make one long.
ROWS = 32_767
#: Rows (context, symbol) of a tree that goes to every executor.
BROADCAST_ROWS = 4_000_000


def padded(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``depth`` boundaries before each row, and the new offsets."""
    n = len(offsets) - 1
    new = offsets + depth * np.arange(n + 1)
    out = np.zeros(int(new[-1]), np.uint8)
    at = np.arange(len(raw)) + np.repeat(depth * np.arange(1, n + 1), np.diff(offsets))
    out[at] = np.maximum(textbytes.lowered(raw), 1)
    return out, new


def positions(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The run of depth + 1 symbols that ends at each symbol, as a number, oldest
    symbol first."""
    x, new = padded(raw, offsets, depth)
    if len(raw) == 0:
        return np.zeros(0, np.int64)
    code = np.zeros(len(x) - depth, np.int64)
    for k in range(depth + 1):
        code <<= 8
        code |= x[k : len(x) - depth + k]
    boundary = np.zeros(len(code), bool)
    for k in range(depth):  # runs that end in a boundary symbol
        p = new[1:-1] + k - depth
        boundary[p[(p >= 0) & (p < len(code))]] = True
    return code[~boundary]


def runs(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(run, count): each distinct run."""
    return np.unique(positions(raw, offsets, depth), return_counts=True)


def own_counts(code: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For the positions of rows (``ROWS`` at most) the counts [depth, position], in
    their own row, of the symbol after its context, and of the context."""
    sizes = np.diff(offsets)
    newest, left = np.zeros(len(code), np.int64), code.copy()
    for _ in range(depth + 1):
        newest = newest << 8 | left & 255
        left >>= 8
    key = np.repeat(np.arange(len(sizes)), sizes) << 8 * (depth + 1) | newest
    order = np.argsort(key)
    key = key[order]
    pair = np.empty((depth + 1, len(code)), np.int32)
    for d in range(depth + 1):
        part = key >> 8 * (depth - d)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(part)))
        pair[d, order] = np.repeat(n, n)
    ctx = np.empty_like(pair)
    ctx[0] = np.repeat(sizes, sizes)
    some = sizes > 0
    starts, ends = offsets[:-1][some], offsets[1:][some] - 1
    last = np.repeat(code[ends], sizes[some])
    for d in range(1, depth + 1):
        # a context is the run before it, but for the one that ends the row
        mask = (1 << 8 * d) - 1
        ctx[d, 1:] = pair[d - 1, :-1]
        ctx[d] -= (code >> 8) & mask == last & mask
        ctx[d, starts] = 1
    return pair, ctx


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([c for c, _ in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(run, n) over the whole corpus."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            code, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["run", "n"])

        for batch in batches:
            raw, off = textbytes.buffers(batch.column(0))
            for a, b in textbytes.slices(off):
                held.append(runs(raw[off[a] : off[b]], off[a : b + 1] - off[a], depth))
                if len(held) > 8:
                    held[:] = [_merged(held)]
                if len(held[0][0]) > HELD:
                    yield out()
                    held.clear()
        if held:
            held[:] = [_merged(held)]
            yield out()

    tune(docs.sparkSession)
    return docs.select("text").mapInArrow(task, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def tree(counted: DataFrame, depth: int = DEPTH, min_share: float | None = None, gain: float = GAIN, min_count: int = MIN_COUNT) -> DataFrame:
    """(d, ctx, sym, n): next-symbol counts of each retained context, oldest
    symbol in the highest byte; the empty context has d = 0.  A ``min_share`` of
    all positions, if given, stands in place of ``min_count``."""
    sym = F.col("run").bitwiseAND(F.lit(255).cast("long"))
    level = cut(counted.select(F.shiftright("run", 8).alias("ctx"), sym.alias("sym"), "n"))
    levels = {depth: level}
    for d in range(depth - 1, -1, -1):
        mask = F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long"))
        levels[d] = cut(levels[d + 1].groupBy(mask.alias("ctx"), "sym").agg(F.sum("n").alias("n")))
    least = min_count if min_share is None else min_share * levels[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = None
    for d in range(depth, 0, -1):
        up = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1).cast("long"))
        sums = levels[d].groupBy("ctx").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
        above = levels[d - 1].groupBy(F.col("ctx").alias("pc")).agg(F.sum("n").alias("pall"))
        rows = levels[d].join(sums, "ctx").withColumn("up", up)
        rows = rows.join(levels[d - 1].select(F.col("ctx").alias("pctx"), F.col("sym").alias("psym"), F.col("n").alias("pn")), (F.col("up") == F.col("pctx")) & (F.col("sym") == F.col("psym")))
        rows = rows.join(above, F.col("up") == F.col("pc"))
        score = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") * F.col("pall") / F.col("pn")))
        chosen = rows.groupBy("ctx").agg(score.alias("g"), F.count("*").alias("k")).where(F.col("g") > gain * F.col("k")).select("ctx")
        if kept is not None:  # suffixes of what is retained below
            chosen = chosen.union(kept.where(F.col("d") == d + 1).select(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long")).alias("ctx"))).distinct()
        own = levels[d].join(chosen, "ctx", "left_semi").select(F.lit(d).alias("d"), "ctx", "sym", "n")
        kept = cut(own if kept is None else kept.unionByName(own))
    return kept.unionByName(levels[0].select(F.lit(0).alias("d"), "ctx", "sym", "n"))


class Model:
    """Rows (d, ctx, sym) as sorted numbers, with their counts, and the contexts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, weight: float):
        self.depth, self.weight = depth, weight
        self.pairs, self.contexts = [], []
        cuts = np.searchsorted(key, np.arange(depth + 2, dtype=np.int64) << 48)
        for d in range(depth + 1):
            own, count = key[cuts[d] : cuts[d + 1]] & ((1 << 48) - 1), n[cuts[d] : cuts[d + 1]]
            ctx = own >> 8
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
            self.pairs.append((own, count))
            self.contexts.append((ctx[first], np.add.reduceat(count, first) if len(first) else count))
        self.counts0 = np.zeros(256, np.int64)
        self.counts0[self.pairs[0][0]] = self.pairs[0][1]

    def found(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts [depth, run] of each run's symbol after its context, and of the
        context; -1 where the context is not retained."""
        n = np.zeros((self.depth + 1, len(run)), np.int64)
        total = np.full((self.depth + 1, len(run)), -1, np.int64)
        n[0], total[0] = self.counts0[run & 255], self.counts0.sum()
        left = np.arange(len(run))
        for d in range(1, self.depth + 1):
            pair = run[left] & ((1 << 8 * (d + 1)) - 1)
            ctx, all_ = self.contexts[d]
            at = np.minimum(np.searchsorted(ctx, pair >> 8), len(ctx) - 1)
            has = ctx[at] == pair >> 8 if len(ctx) else np.zeros(len(left), bool)
            # suffixes of retained contexts are retained: what is missing here is missing below
            left, pair, at = left[has], pair[has], at[has]
            if not len(left):
                break
            own, count = self.pairs[d]
            where = np.minimum(np.searchsorted(own, pair), len(own) - 1)
            n[d, left] = np.where(own[where] == pair, count[where], 0)
            total[d, left] = all_[at]
        return n, total

    def score(self, raw: np.ndarray, offsets: np.ndarray, own: bool = False) -> np.ndarray:
        """Bits of each row; own: the rows are of the corpus, and their counts left out."""
        rows = len(offsets) - 1
        out = np.zeros(rows)
        for a in range(0, rows, ROWS):
            b = min(rows, a + ROWS)
            off = offsets[a : b + 1] - offsets[a]
            code = positions(raw[offsets[a] : offsets[b]], off, self.depth)
            run, at = np.unique(code, return_inverse=True)
            n, total = self.found(run)
            if own:
                pair, ctx = own_counts(code, off, self.depth)
            p = None
            for d in range(self.depth + 1):
                x, y = n[d][at], total[d][at]
                has = y >= 0
                if own:
                    x, y = x - pair[d], y - ctx[d]
                if d == 0:
                    p = (x + UNIFORM) / (y + 256 * UNIFORM)
                else:
                    np.divide(x + self.weight * p, y + self.weight, out=p, where=has)
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), np.diff(off)), weights=-np.log2(p), minlength=b - a)
        return out


@lru_cache(maxsize=1)
def _model(key: bytes, depth: int, weight: float) -> Model:
    return Model(*np.frombuffer(key, np.int64).reshape(2, -1), depth, weight)


def _collected(kept: DataFrame) -> np.ndarray:
    got = kept.toArrow()
    rows = np.array([got.column(c).to_numpy().astype(np.int64) for c in ("d", "ctx", "sym", "n")])
    return rows[:, np.lexsort((rows[2], rows[1], rows[0]))]


def train(docs: DataFrame, depth: int = DEPTH, min_share: float | None = None, gain: float = GAIN, min_count: int = MIN_COUNT) -> np.ndarray:
    """The retained contexts as a 4-row array d, ctx, sym, n."""
    return _collected(tree(counts(docs, depth), depth, min_share, gain, min_count))


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type(docs)), T.StructField("n_symbols", T.LongType()), T.StructField("bits_per_symbol", T.DoubleType())])


def score(docs: DataFrame, model: np.ndarray, depth: int = DEPTH, weight: float = WEIGHT, own: bool = False) -> DataFrame:
    """(doc_id, n_symbols, bits_per_symbol) of each row; own: the rows are those that
    the model was made of, and each is scored by the others."""
    d, ctx, sym, n = model
    sent = docs.sparkSession.sparkContext.broadcast(np.array([d << 48 | ctx << 8 | sym, n]).tobytes())
    schema = _schema(docs)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value, depth, weight)
        raw, off = textbytes.buffers(batch.column(1))
        bits = np.concatenate([m.score(raw[off[a] : off[b]], off[a : b + 1] - off[a], own) for a, b in textbytes.slices(off)])
        size = np.diff(off)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.round(bits / np.maximum(size, 1), 6), mask=size == 0)], names=schema.names)

    return map_rows(docs.select("doc_id", "text"), schema, run)


def _joined(docs: DataFrame, kept: DataFrame, depth: int, weight: float) -> DataFrame:
    """The way for a large tree: runs of texts are joined with it."""

    names = ["h", "run", "k", *[f"{x}{d}" for x in "oc" for d in range(depth + 1)]]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = textbytes.buffers(batch.column(1))
        for i in range(batch.num_rows):
            code = positions(raw[off[i] : off[i + 1]], off[i : i + 2] - off[i], depth)
            run, first, n = np.unique(code, return_index=True, return_counts=True)
            pair, ctx = own_counts(code, np.array([0, len(code)]), depth)
            own = [pa.array(x[d][first].astype(np.int64)) for x in (pair, ctx) for d in range(depth + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(run), i))), pa.array(run), pa.array(n), *own], names=names)

    hashed = docs.select(F.xxhash64("text").alias("h"), "text").where("octet_length(text) > 0").dropDuplicates(["h"])
    own = cut(map_rows(hashed, ", ".join(f"{n} long" for n in names), each))
    total = kept.where("d = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = own.select("run").distinct().withColumn("sym", F.col("run").bitwiseAND(F.lit(255).cast("long")))
    known = known.join(kept.where("d = 0").select("sym", F.col("n").alias("n0")), "sym", "left").select("run", "sym", F.coalesce("n0", F.lit(0)).alias("n0"))
    for d in range(1, depth + 1):
        level = kept.where(F.col("d") == d)
        at = known.withColumn("ctx", F.shiftright("run", 8).bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long")))
        found = at.join(level.groupBy("ctx").agg(F.sum("n").alias(f"t{d}")), "ctx", "left").join(level.select("ctx", "sym", F.col("n").alias(f"n{d}")), ["ctx", "sym"], "left")
        known = cut(found.select(*known.columns, F.coalesce(f"n{d}", F.lit(0)).alias(f"n{d}"), f"t{d}"))
    p = (F.col("n0") - F.col("o0") + UNIFORM) / (F.lit(total) - F.col("c0") + 256 * UNIFORM)
    for d in range(1, depth + 1):
        p = F.when(F.col(f"t{d}").isNull(), p).otherwise((F.col(f"n{d}") - F.col(f"o{d}") + weight * p) / (F.col(f"t{d}") - F.col(f"c{d}") + weight))
    bits = own.join(known, "run").groupBy(F.col("h").alias("__h")).agg(F.sum(-F.col("k") * F.log2(p)).alias("__bits"))
    named = docs.select("doc_id", "text").join(bits, F.xxhash64("text") == F.col("__h"), "left")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return named.select("doc_id", size.alias("n_symbols"), F.when(size > 0, F.round(F.col("__bits") / size, 6)).alias("bits_per_symbol"))


def score_corpus(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    kept = cut(tree(counts(docs)))
    if kept.count() <= broadcast_rows:
        return score(docs, _collected(kept), own=True)
    return _joined(docs, kept, DEPTH, WEIGHT)

"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled of good quality and not toxic; the
unlabelled text is the whole corpus.  Its terms cover every document: nothing of it
is sampled.  Positives are ``POSITIVES`` at most (those with the least hashes of
doc_id, a bounded sample of labelled rows), in three folds:

1. Word counts: in how many documents of the corpus, and of fold 0, each word is.
   Words that trusted documents hold more seldom than the corpus, by a signed root of
   the likelihood ratio of ``Z`` or more, are the lexicon (the ``LEXICON`` most
   telling ones), with the logarithm of the ratio of the shares.  Words keep to
   themselves, so a rare insult counts.
2. Each document becomes ``WIDTH`` features: its lexicon words by ratio, its pairs of
   character classes, its length and variety.  These are written once.
3. A linear model of squared loss minimises the unbiased risk
   pi*R+(P) + R-(U) - pi*R-(P).  That risk depends on the first and second moments of
   fold 1 and of the corpus only, so one pass sums them, and its minimum is exact.
   Where R-(U) - pi*R-(P) is negative there, descent by the non-negative risk (Kiryo
   et al., 2017) takes its place: that part's gradient is ascended while it is
   negative.
4. The class prior pi is the best-bin estimate (Garg et al., 2021) of the scores of
   fold 2 against the corpus, from histograms, by a model of P against U.

The squared loss makes (1 + z) / 2 the estimate of the share of positives among
documents of that score; a document is kept if it is one half at least.

Defined cases: a null or empty text has features 0 but for the bias, and its
score follows; a null doc_id is scored and part of the corpus but no positive;
repeated doc_ids are documents of their own, of labels one; a document labelled
twice is positive if any row says so; labels that are null count as none; with no
positives or no documents every score is null and every document kept; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import textbytes
from quern.llm.common import fresh, id_type, map_rows, stored, tune

POSITIVES = 20_000
LEXICON = 65_536
Z = 3.3
#: Parts of ten of the positives in folds 0, 1 and 2.
FOLDS = (6, 3, 1)
DECAY = 1e-3
#: Distinct words that a task holds before it hands them on.
HELD = 1_000_000
BINS = 4_096
_ROWS = 2_048

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[44, 46, 58, 59]] = 6
_CLASS[[33, 63]] = 7
_CLASS[[34, 39, 40, 41, 45]] = 8
_CLASS[[35, 36, 37, 38, 42, 64, 94, 126]] = 9
_CLASS[[60, 62, 124, 91, 93, 123, 125, 92, 47, 95, 61]] = 10
_CLASS[128:] = 11
KINDS = 12
#: Logarithms of ratios where the lexicon's words are parted.
EDGES = np.array([-4.0, -3.0, -2.0, -1.2, -0.6, -0.25])
STEPS = len(EDGES) + 1
WIDTH = KINDS * KINDS + 2 * STEPS + 4


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of each distinct word of each row, by row, and all words of a row."""
    starts, ends, firsts = textbytes.word_spans(raw, offsets)
    n = np.diff(firsts)
    row, hashes = np.repeat(np.arange(len(n)), n), textbytes.word_hashes(raw, starts, ends)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new], n


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows."""
    raw, off = textbytes.buffers(column)
    for a0, b0 in textbytes.slices(off):
        for a in range(a0, b0, _ROWS):
            b = min(b0, a + _ROWS)
            yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]


def features(column: pa.Array, key: np.ndarray, ratio: np.ndarray) -> Iterator[np.ndarray]:
    """Feature matrices of consecutive rows; key: the lexicon's sorted hashes."""
    step = np.searchsorted(EDGES, ratio, side="right")
    for a, b, part, po in _parts(column):
        n = b - a
        out = np.zeros((n, WIDTH), np.float32)
        row, hashes, count = words(part, po)
        distinct = np.bincount(row, minlength=n)
        if len(key):
            at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            known = key[at] == hashes
            row, at = row[known], at[known]
            by = np.bincount(row * STEPS + step[at], minlength=n * STEPS).reshape(n, STEPS)
            out[:, :STEPS] = np.log1p(by)
            out[:, STEPS : 2 * STEPS] = by / np.maximum(distinct, 1)[:, None]
            out[:, 2 * STEPS] = np.bincount(row, weights=ratio[at], minlength=n) / np.maximum(distinct, 1)
        size = np.diff(po)
        if len(part) > 1:
            kind = _CLASS[part]
            pair = kind[:-1] * KINDS + kind[1:] + np.repeat(np.arange(n) * KINDS * KINDS, size)[:-1]
            inner = np.ones(len(pair), bool)
            cuts = po[1:-1] - 1
            inner[cuts[(cuts >= 0) & (cuts < len(pair))]] = False
            got = np.bincount(pair[inner], minlength=n * KINDS * KINDS).reshape(n, -1)
            out[:, 2 * STEPS + 1 : -3] = np.sqrt(got / np.maximum(size, 1)[:, None])
        out[:, -3] = np.log1p(size) / 10
        out[:, -2] = distinct / np.maximum(count, 1)
        out[:, -1] = 1
        yield out.astype(np.float16).astype(np.float32)


@dataclass(frozen=True)
class Moments:
    """Rows, sum of features and sum of their products."""

    n: float
    first: np.ndarray
    second: np.ndarray

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        return self.first / self.n, self.second / self.n


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    key: np.ndarray
    ratio: np.ndarray


def risks(w: np.ndarray, p: Moments, u: Moments) -> tuple[float, float, float]:
    """(R+(P), R-(P), R-(U)) of the squared loss (1 - yz)^2 / 4."""
    (a, aa), (b, bb) = p.mean(), u.mean()
    of = lambda m, mm, y: float(1 - 2 * y * (w @ m) + w @ mm @ w) / 4
    return of(a, aa, 1), of(a, aa, -1), of(b, bb, -1)


def gradient(w: np.ndarray, p: Moments, u: Moments, prior: float) -> np.ndarray:
    """Of the non-negative risk, or against its second part while that is negative."""
    (a, aa), (b, bb) = p.mean(), u.mean()
    up, down_p, down_u = (aa @ w - a) / 2, (aa @ w + a) / 2, (bb @ w + b) / 2
    _, rp, ru = risks(w, p, u)
    part = down_u - prior * down_p
    return prior * up + part if ru - prior * rp >= 0 else -part


def fit(p: Moments, u: Moments, prior: float, decay: float = DECAY, steps: int = 2_000, rate: float = 0.01) -> np.ndarray:
    """Weights of the least non-negative risk, features scaled by the corpus."""
    b, bb = u.mean()
    scale = np.sqrt(np.maximum(np.diag(bb) - b * b, 0)) + 1e-3
    scale[-1] = 1
    scaled = lambda m: Moments(m.n, m.first / scale, m.second / scale / scale[:, None])
    p, u = scaled(p), scaled(u)
    a, (b, bb) = p.mean()[0], u.mean()
    held = decay * np.eye(len(b))
    held[-1, -1] = 0
    w = np.linalg.solve(bb + held + 1e-9 * np.eye(len(b)), 2 * prior * a - b)
    _, rp, ru = risks(w, p, u)
    if ru - prior * rp < 0:
        w, m, v = np.zeros(len(b)), np.zeros(len(b)), np.zeros(len(b))
        for k in range(1, steps + 1):
            g = gradient(w, p, u, prior) + held @ w / 2
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w / scale


def plain(p: Moments, u: Moments, decay: float = DECAY) -> np.ndarray:
    """Weights of least squares of P against U, half of the weight each."""
    (a, aa), (b, bb) = p.mean(), u.mean()
    mean = (aa + bb) / 2
    held = decay * np.diag(np.diag(mean)) + 1e-9 * np.eye(len(a))
    return np.linalg.solve(mean + held, (a - b) / 2)


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives in u, from counts of scores in
    bins of rising score."""
    qp, qu = p[::-1].cumsum()[::-1] / p.sum(), u[::-1].cumsum()[::-1] / u.sum()
    some = qp > 0
    slack = np.sqrt(np.log(4 / delta) / (2 * u.sum())) + np.sqrt(np.log(4 / delta) / (2 * p.sum()))
    best = int(np.argmin((qu[some] + slack) / qp[some]))
    return float(np.clip(qu[some][best] / qp[some][best], 0.01, 0.99))


def _word_counts(docs: DataFrame, fold: str) -> DataFrame:
    """(h, n, m): documents that hold a word, and those of them in fold 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            x = np.concatenate(held, axis=1)
            x = x[:, np.argsort(x[0], kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], x[0, 1:] != x[0, :-1])))
            return np.array([x[0, first], *np.add.reduceat(x[1:], first, axis=1)])

        for batch in batches:
            chosen = (batch.column(1).fill_null(-1).to_numpy() == 0).astype(np.int64)
            for a, b, part, po in _parts(batch.column(0)):
                row, hashes, _ = words(part, po)
                if len(row):
                    held.append(np.array([hashes.view(np.int64), np.ones(len(row), np.int64), chosen[a:b][row]]))
                    if sum(x.shape[1] for x in held) > HELD:
                        held[:] = [merged()]
                        if held[0].shape[1] > HELD // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["h", "n", "m"])
                            held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["h", "n", "m"])

    tune(docs.sparkSession)
    return docs.select("text", fold).mapInArrow(task, "h long, n long, m long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def lexicon(counts: DataFrame, n_all: int, n_chosen: int, z: float = Z, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, logarithms of ratios) of the telling words."""
    if n_chosen == 0:
        return np.zeros(0, np.uint64), np.zeros(0)
    n, m, total = F.col("n").cast("double"), F.col("m").cast("double"), F.lit(float(n_all + n_chosen))
    # 2 * sum of observed * log(observed / expected) of the table with and without the word
    part = lambda seen, size, all_: F.when(seen > 0, seen * F.log(seen * total / (F.lit(float(size)) * all_))).otherwise(0.0)
    held, free = n + m, total - n - m
    g = 2 * (part(n, n_all, held) + part(m, n_chosen, held) + part(F.lit(float(n_all)) - n, n_all, free) + part(F.lit(float(n_chosen)) - m, n_chosen, free))
    rarer = m * n_all < n * n_chosen
    telling = counts.where(rarer).select("h", "n", "m", F.round(F.sqrt(F.greatest(g, F.lit(0.0))), 9).alias("z")).where(F.col("z") >= z).orderBy(F.desc("z"), "h").limit(most)
    got = telling.toArrow()
    h, n, m = (got.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "m"))
    ratio = np.log((m + 0.5) / (n_chosen + 1)) - np.log((n + 0.5) / (n_all + 1))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], ratio[order]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, _ = textbytes.buffers(column)
    return np.frombuffer(raw.tobytes(), np.float16).reshape(-1, WIDTH).astype(np.float64)


def moments(table: DataFrame) -> tuple[Moments, Moments]:
    """Of fold 1 and of the whole table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for batch in batches:
            x, fold = _matrix(batch.column(1)), batch.column(0).fill_null(-1).to_numpy()
            for k, own in enumerate((x[fold == 1], x)):
                sums[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        index = np.tile(np.arange(sums.shape[1], dtype=np.int32), 2)
        which = np.repeat(np.arange(2, dtype=np.int32), sums.shape[1])
        kept = sums.ravel() != 0
        yield pa.RecordBatch.from_arrays([pa.array(which[kept]), pa.array(index[kept]), pa.array(sums.ravel()[kept])], names=["k", "i", "v"])

    got = table.select("fold", "x").mapInArrow(task, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    out[got.column("k").to_numpy(), got.column("i").to_numpy()] = got.column("v").to_numpy()
    p, u = (Moments(x[0], x[1 : 1 + WIDTH], x[1 + WIDTH :].reshape(WIDTH, WIDTH)) for x in out)
    return p, u


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip((z + 2) * (BINS / 4), 0, BINS - 1).astype(np.int64)


def histograms(table: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of scores of fold 2 and of the whole table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS), np.int64)
        for batch in batches:
            at, fold = _bins(_matrix(batch.column(1)) @ weights), batch.column(0).fill_null(-1).to_numpy()
            sums += np.array([np.bincount(at[fold == 2], minlength=BINS), np.bincount(at, minlength=BINS)])
        k, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[k, i])], names=["k", "i", "v"])

    got = table.select("fold", "x").mapInArrow(task, "k int, i int, v long").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((2, BINS), np.int64)
    out[got.column("k").to_numpy(), got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out[0], out[1]


def folded(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> DataFrame:
    """(doc_id, text, fold) of every row: the fold of a trusted positive, else null."""
    spread = lambda seed: F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    name = fresh(docs, "__id")
    # the limit bounds the broadcast
    ten = F.pmod(spread(29), F.lit(sum(FOLDS)))
    fold = F.when(ten < FOLDS[0], 0).when(ten < FOLDS[0] + FOLDS[1], 1).otherwise(2)
    good = good.orderBy(spread(11), "doc_id").limit(positives).select(F.col("doc_id").alias(name), fold.alias("fold"))
    own = docs.select("doc_id", "text")
    return own.join(F.broadcast(good), F.col("doc_id") == F.col(name), "left").select("doc_id", "text", "fold")


def prepared(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The features of every row (doc_id, fold, x), written, and the lexicon."""
    named = folded(docs, labels, positives)
    sizes = named.agg(F.count("*"), F.coalesce(F.sum((F.col("fold") == 0).cast("long")), F.lit(0))).first()
    key, ratio = lexicon(_word_counts(named, "fold"), *sizes)
    schema = T.StructType([T.StructField("doc_id", id_type(docs)), T.StructField("fold", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for x in features(batch.column(1), key, ratio):
            data = pa.py_buffer(x.astype(np.float16).tobytes())
            ends = pa.py_buffer((np.arange(len(x) + 1) * WIDTH * 2).astype(np.int32).tobytes())
            made = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, data])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(2).slice(at, len(x)), made], names=schema.names)
            at += len(x)

    return stored(map_rows(named.select("doc_id", "text", "fold"), schema, run)), key, ratio


def train(table: DataFrame, key: np.ndarray, ratio: np.ndarray) -> Model | None:
    """The model of a table made by ``prepared``; None without positives."""
    p, u = moments(table)
    if not p.n or not u.n:
        return None
    held, every = histograms(table, plain(p, u))
    prior = estimate_prior(held if held.sum() else every, every)
    return Model(fit(p, u, prior), prior, key, ratio)


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, quality_score, keep) of each row of a table made by ``prepared``."""
    if model is None:
        return table.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(True).alias("keep"))
    schema = T.StructType([table.schema["doc_id"], T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = np.round(np.clip((1 + _matrix(batch.column(1)) @ model.weights) / 2, 0, 1), 6)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= 0.5)], names=schema.names)

    return map_rows(table.select("doc_id", "x"), schema, run)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table, key, ratio = prepared(docs, labels)
    return score(table, train(table, key, ratio))

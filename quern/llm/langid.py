"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of its labelled
text: of ``SAMPLE_ROWS`` distinct rows at most, of any length, a slice of
``ROW_CHARS`` characters each, ``SAMPLE_BYTES`` in all (less if more than 15
languages share the table).  A document is parsed into longest phrases that occur in that sample
(Ziv-Merhav cross-parsing): walking the automaton from its root, a phrase ends
where no transition exists.  With c phrases over N symbols and a sample of n
symbols the cross-entropy estimate is c*log2(n)/N bits a symbol; the language
that needs the fewest normalised phrases wins.  A document is rejected if it
has no letters, or if its best estimate is above ``reject_ratio`` times what
held-out labelled rows of that language need.

Texts are read as bytes: lower-cased, each run of what is neither letter, mark nor
number above U+007F as one space.
Whole texts are parsed, in segments of 512 symbols that each start a phrase.

Defined cases: a null or empty text, or one without letters, has lang_pred null,
bits null and is rejected; ties go to the alphabetically first language; rows
are independent, so repeated rows get the same verdict and are one row of the
sample; a blank label is none, a label of which no row has a letter is no
language; no labelled rows at all leaves every row unpredicted but not rejected;
more than ``MAX_LANGS`` labels are an error; other columns are not read.  Texts under ``min_symbols`` symbols are never rejected for their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import lockstep, textbytes
from quern.llm.common import id_type, map_rows

SAMPLE_BYTES = 32_768
SAMPLE_ROWS = 256
ROW_CHARS = 1_024
#: Rows that pass the first choice, for each one wanted.
SPARE = 8
MAX_LANGS = 256
REJECT_RATIO = 2.4
MIN_SYMBOLS = 24
TABLE_BYTES = 256 << 20

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with single spaces between, and the new row offsets;
    no row starts or ends with a space."""
    n = len(raw)
    if n == 0:
        return raw, np.zeros(len(offsets), np.int64)
    x = _CLASS[textbytes.lowered(raw)]
    x[~textbytes.inside(raw)] = 32
    letter = x != 32
    keep = letter.copy()
    # a space is kept if a letter stands before it in its row, and one follows
    first = ~letter
    first[1:] &= letter[:-1]
    starts = offsets[:-1]
    first[starts[starts < n]] = False
    at = np.flatnonzero(first)
    letters = np.flatnonzero(letter)
    following = np.searchsorted(letters, at)
    row_end = offsets[np.searchsorted(offsets, at, side="right")]
    ok = following < len(letters)
    ok[ok] = letters[following[ok]] < row_end[ok]
    keep[at[ok]] = True
    cum = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], cum[offsets]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Suffix automaton as a table [state, symbol] -> state, -1 where none."""
    link, length, nxt, last = [-1], [0], [{}], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    out = np.full((len(nxt), width), -1, np.int32)
    for s, to in enumerate(nxt):
        if to:
            out[s, list(to)] = list(to.values())
    return out


class Model:
    """All languages' automata in one table.  An entry is 2*state + 1 if the
    symbol starts a phrase, else 2*state."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [k for k, _ in samples]
        self.sizes = np.array([max(2, len(v)) for _, v in samples], float)
        seen = sorted(set(b"".join(v for _, v in samples)))
        self.code = np.zeros(256, np.uint8)
        for i, b in enumerate(seen):
            self.code[b] = i + 1
        self.width = len(seen) + 1
        parts, self.roots, base = [], [], 0
        for _, text in samples:
            t = automaton(self.code[np.frombuffer(text, np.uint8)].tolist(), self.width)
            root = np.where(t[0] >= 0, t[0], 0)
            flat = np.where(t >= 0, 2 * (t + base), 2 * (root + base)[None, :] + 1)
            flat[0] = 2 * (root + base) + 1
            parts.append(flat.astype(np.int32))
            self.roots.append(base)
            base += len(t)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row in each language."""
        rows, k = len(offsets) - 1, len(self.langs)
        total = np.zeros((k, rows), np.int64)
        if k == 0:
            return total
        start, size, row, _ = lockstep.segments(offsets)
        x_all = self.code[symbols]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(start), 1)
        count = np.zeros((k, len(start)), np.int32)

        def step(t: int, n: int, x: np.ndarray) -> None:
            v = self.table.take(state[:, :n] * np.int32(self.width) + x)
            count[:, :n] += v & 1
            np.right_shift(v, 1, out=state[:, :n])

        lockstep.walk(x_all, start, size, step)
        for i in range(k):
            total[i] = np.bincount(row, weights=count[i], minlength=rows)[:rows]
        return total


@lru_cache(maxsize=1)
def model(samples: tuple[tuple[str, bytes], ...]) -> Model:
    return Model(samples)


def _texts(texts: list[str]) -> bytes:
    raw, off = textbytes.buffers(pa.array(texts, pa.string()))
    symbols, offsets = normal(raw, off)
    data = symbols.tobytes()
    return b" ".join(data[a:b] for a, b in zip(offsets[:-1], offsets[1:]) if b > a)


def chosen(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> dict[str, list[str]]:
    """Slices of the ``sample_rows`` distinct labelled rows of each language with the
    least hashes, in their order.

    Languages are sized by counting distinct hashes approximately; of a language
    only rows pass whose hash is in the share that holds ``SPARE`` times as many as
    are wanted, so what is gathered is bounded and repeats fold where they are."""
    text = F.col("text")
    rows = docs.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(7)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & text.rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGS + 1).collect()
    if not sizes:
        return {}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    edges = [(r.lang, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, SPARE * sample_rows / max(1, r.n))))) for r in sizes]
    edge = F.element_at(F.create_map(*[F.lit(x) for e in edges for x in e]), F.col("lang"))
    begin = F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.char_length(text) - row_chars + 1).cast("long")).cast("int")
    some = rows.where(F.col("h") <= edge).select("lang", "h", F.substring(text, begin, F.lit(row_chars)).alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_rows)
    by: dict[str, list[str]] = {}
    for lang, part, _ in sorted(some.select("lang", "part", "r").collect(), key=lambda x: (x[0], x[2])):
        by.setdefault(lang, []).append(part)
    return by


def cleaned(by: dict[str, list[str]], sample_bytes: int) -> dict[str, list[str]]:
    """The samples without rows that are unlike the rest of their language, as
    wrongly labelled ones are: each half is parsed with the other, and rows that need
    over ``REJECT_RATIO`` times the median bits go."""
    out: dict[str, list[str]] = {}
    for lang, rows in by.items():
        bits = np.zeros(len(rows))
        for k in (0, 1):
            m = Model(((lang, _texts(rows[1 - k :: 2])[:sample_bytes]),))
            raw, off = textbytes.buffers(pa.array(rows[k::2], pa.string()))
            symbols, offsets = normal(raw, off)
            size = np.diff(offsets)
            bits[k::2] = np.where(size >= MIN_SYMBOLS, m.phrases(symbols, offsets)[0] * np.log2(m.sizes[0]) / np.maximum(1, size), 0)
        usual = np.median(bits[bits > 0]) if (bits > 0).any() else 0
        out[lang] = [row for row, b in zip(rows, bits) if b <= REJECT_RATIO * usual or b == 0] if len(rows) > 2 else rows
    return out


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> tuple[tuple[tuple[str, bytes], ...], tuple[float, ...]]:
    """(samples, held-out bits) per language from rows with a label.

    Every second row of the sample is held out to set the usual bits."""
    by = chosen(docs, sample_rows, row_chars)
    sample_bytes = min(sample_bytes, TABLE_BYTES // (512 * max(1, len(by))))
    by = cleaned(by, sample_bytes)
    samples, held = [], {}
    for lang in sorted(by):
        mine = by[lang]
        text = _texts(mine[::2])[:sample_bytes]
        if text:
            samples.append((lang, text))
            held[lang] = mine[1::2] or mine
    m = model(tuple(samples))
    usual = []
    for i, (lang, text) in enumerate(samples):
        raw, off = textbytes.buffers(pa.array(held[lang], pa.string()))
        symbols, offsets = normal(raw, off)
        c = m.phrases(symbols, offsets)[i].sum()
        usual.append(float(c * np.log2(m.sizes[i]) / max(1, offsets[-1])))
    return tuple(samples), tuple(usual)


def score(column: pa.Array, samples: tuple, usual: tuple, reject_ratio: float, min_symbols: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(language, bits, symbols, rejected) of each text of a column."""
    m = model(samples)
    raw, off = textbytes.buffers(column)
    n = len(off) - 1
    best, bits, size = np.full(n, -1), np.full(n, np.nan), np.zeros(n, np.int64)
    for a, b in textbytes.slices(off):
        symbols, offsets = normal(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        size[a:b] = np.diff(offsets)
        if m.langs:
            cost = m.phrases(symbols, offsets) * np.log2(m.sizes)[:, None] / np.maximum(1, size[a:b])
            best[a:b] = cost.argmin(0)
            bits[a:b] = cost.min(0)
    best[size == 0] = -1
    bits[size == 0] = np.nan
    rejected = size == 0
    if m.langs:
        limit = reject_ratio * np.array(usual)[best]
        rejected |= (size >= min_symbols) & (bits > limit)
    return [m.langs[i] if i >= 0 else None for i in best], bits, size, rejected


def identify(docs: DataFrame, reject_ratio: float = REJECT_RATIO, min_symbols: int = MIN_SYMBOLS, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> DataFrame:
    """doc_id, lang_pred, bits, n_symbols, rejected of every row."""
    samples, usual = train(docs, sample_bytes, sample_rows, row_chars)
    schema = T.StructType([T.StructField("doc_id", id_type(docs)), T.StructField("lang_pred", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("n_symbols", T.LongType()), T.StructField("rejected", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, bits, size, rejected = score(batch.column(1), samples, usual, reject_ratio, min_symbols)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang, pa.string()), pa.array(np.round(bits, 6), pa.float64(), mask=np.isnan(bits)), pa.array(size), pa.array(rejected)],
            names=["doc_id", "lang_pred", "bits", "n_symbols", "rejected"],
        )

    return map_rows(docs.select("doc_id", "text"), schema, run)


def keep_identified(docs: DataFrame, reject_ratio: float = REJECT_RATIO, min_symbols: int = MIN_SYMBOLS, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    samples, usual = train(docs, sample_bytes, sample_rows, row_chars)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rejected = score(batch.column(at), samples, usual, reject_ratio, min_symbols)[3]
        yield batch.filter(pa.array(~rejected))

    return map_rows(docs, docs.schema, run)

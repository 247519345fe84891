"""Vectorised text kernels over Arrow string buffers.

Every kernel works on the UTF-8 bytes of a whole column slice at once, so no
Python object is made per row or per word.  A *word* is a maximal run of letters,
marks and numbers (Unicode's L, M, N), lower-cased; everything else separates,
typographic quotes and dashes too.  Lower-casing keeps the number of bytes; the
few letters whose lower case has another (such as U+0130 and U+1E9E) stay as they
are.  Null texts count as empty.  All hashes are fixed functions of the bytes:
they are the same in any process, on any machine and for any batching.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes whose words are hashed at a time: bounds the working arrays.
BLOCK_BYTES = 1 << 20
#: Bytes of text handled per slice of a batch (one longer text is its own slice).
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_POSITIONS = 1 << 12


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MULTIPLIERS = mix64(np.arange(_POSITIONS, dtype=np.uint64)) | np.uint64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


@cache
def _tables() -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For characters of two, three and four bytes (those of planes 0 and 1): their
    lower case and whether they are of words, by code point; and of each first byte
    whether some character that it begins has a lower case."""
    lower, word, cased = [], [], []
    for size, (first, last) in zip((2, 3, 4), ((0x80, 0x800), (0x800, 0x10000), (0x10000, 0x20000))):
        to, own, lead = np.arange(last, dtype=np.int64), np.ones(last, bool), np.zeros(256, bool)
        for c in range(first, last):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            own[c] = unicodedata.category(x)[0] in "LMN"
            low = x.lower()
            if low != x and len(low) == 1 and len(low.encode()) == size:
                to[c] = ord(low)
                lead[x.encode()[0]] = True
        lower.append(to)
        word.append(own)
        cased.append(lead)
    return lower, word, cased


_LEADS = ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5))


def _points(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose characters of ``size`` bytes are whole, and their code points."""
    at = at[at <= len(raw) - size]
    point = raw[at].astype(np.int64) & (0x7F >> size)
    for k in range(1, size):
        point = point << 6 | raw[at + k] & 63
    return at, point


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case, in place of length."""
    low = _LOWER[raw]
    lead = np.flatnonzero(raw >= 0xC3)
    if len(lead) == 0:
        return low
    first = raw[lead]
    lower, _, cased = _tables()
    for size, to, some in zip((2, 3, 4), lower, cased):
        at, point = _points(raw, lead[some[first]], size)
        ok = point < len(to)
        new = to[point[ok]]
        moved = new != point[ok]
        at, new = at[ok][moved], new[moved]
        for k in range(size - 1, 0, -1):
            low[at + k] = 128 | new & 63
            new = new >> 6
        low[at] = (0xF00 >> size & 0xFF) | new
    return low


def inside(raw: np.ndarray) -> np.ndarray:
    """Which bytes are of words."""
    own = _IS_WORD[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        first = raw[lead]
        for size, (a, b), word in zip((2, 3, 4), _LEADS, _tables()[1]):
            at, point = _points(raw, lead[(first >= a) & (first < b)], size)
            at = at[~word[np.minimum(point, len(word) - 1)] & (point < len(word))]
            for k in range(size):
                own[at + k] = False
    return own


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row); words never cross rows."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    own = inside(raw)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = own[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(own & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = own[1:]
    ends_at = cuts[(cuts > 0)] - 1
    after[ends_at] = False
    ends = np.flatnonzero(own & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    cum = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + BLOCK_BYTES, side="right")) - 1)
        lo, hi = starts[at], ends[to - 1]
        low = lowered(raw[lo:hi])
        size, first = lengths[at:to], cum[at:to] - cum[at]
        shift = np.repeat(starts[at:to] - lo - first, size)
        index = np.arange(len(shift))
        place = index - np.repeat(first, size)
        values = (low[index + shift].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[place & (_POSITIONS - 1)]
        out[at:to] = np.add.reduceat(values, first)
        at = to
    return mix64(out ^ (lengths.astype(np.uint64) << np.uint64(48)))


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of ``width`` words, first of each row); a row with fewer
    words, but one at least, has its whole run as its one shingle."""
    counts = np.diff(firsts)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    rows = np.concatenate(([0], np.cumsum(made)))
    total = int(rows[-1])
    if total == 0:
        return np.zeros(0, np.uint64), rows
    begin = np.repeat(firsts[:-1] - rows[:-1], made) + np.arange(total)
    have = np.minimum(np.repeat(counts, made), width)
    acc = np.zeros(total, np.uint64)
    last = len(hashes) - 1
    for k in range(width):
        part = hashes[np.minimum(begin + k, last)] * _MULTIPLIERS[k + 7]
        acc += np.where(k < have, part, np.uint64(0)) if have.min() < width else part
    return mix64(acc + have.astype(np.uint64)), rows

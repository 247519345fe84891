"""Token counts of byte-pair vocabularies, without encoding every text.

A vocabulary of ranks splits text by a fixed pattern before it merges, so a
text's count is the sum over its pieces.  Pieces are cut for a whole column
slice at once on its code points, hashed, and looked up in a direct-mapped
cache; only pieces not in the cache are encoded.  The counts equal those of
encoding the texts (but for a 64-bit hash collision)."""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quern.llm import textbytes
from quern.llm.common import ragged_sum

#: The pattern that the cutting below follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
_SLOTS = 1 << 21
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            table[i] = _LETTER
        elif c == "N":
            table[i] = _NUMBER
    table[_SPACES] = _SPACE
    return table


def pieces(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each piece begins; pieces tile the code points and never cross rows."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    run = begins[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(run)
    to = np.append(at[1:], n)
    kind = cls[at]
    start = np.zeros(n + 1, bool)
    space = kind == _SPACE
    # white space: its first, and its last if a run follows in the row
    start[at[space]] = True
    followed = space & ~begins[to]
    start[to[followed] - 1] = True
    # other runs: unless a blank right before belongs to them
    word = ~space
    lead = np.zeros(len(at), bool)
    inner = word & ~begins[:n][at]
    lead[inner] = points[at[inner] - 1] == 32
    start[at[word & ~lead]] = True
    # contractions: a lone apostrophe that begins a piece
    tick = np.flatnonzero((kind == _OTHER) & ~lead & (to - at == 1) & (points[at] == 39))
    tick = tick[tick + 1 < len(at)]
    tick = tick[(kind[tick + 1] == _LETTER) & ~begins[:n][at[tick + 1]]]
    for k in tick:
        a, size = at[k] + 1, to[k + 1] - at[k + 1]
        first = chr(points[a])
        two = first + chr(points[a + 1]) if size > 1 else ""
        took = 1 if first in "st" else 2 if two in ("re", "ve") else 1 if first == "m" else 2 if two == "ll" else 1 if first == "d" else 0
        if took:
            start[a] = False
            if size > took:
                start[a + took] = True
    return np.flatnonzero(start[:n])


class Counter:
    """Counts pieces for several vocabularies at once."""

    def __init__(self, folder: str, names: tuple[str, ...]):
        import tiktoken

        self.codes = []
        for name in names:
            with open(f"{folder}/{name}.tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.codes.append(tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.values = np.zeros((len(names), _SLOTS), np.int32)

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text, a row for each vocabulary."""
        raw, off = textbytes.buffers(column)
        out = np.zeros((len(self.codes), len(off) - 1), np.int64)
        for a, b in textbytes.slices(off, 1 << 20):
            part = raw[off[a] : off[b]]
            points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            heads = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            rows = heads[off[a : b + 1] - off[a]]
            start = pieces(points, rows)
            if not len(start):
                continue
            length = np.diff(np.append(start, len(points)))
            place = np.arange(len(points)) - np.repeat(start, length)
            mult = textbytes._MULTIPLIERS
            h = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * mult[place & (len(mult) - 1)], start)
            h = textbytes.mix64(h ^ (length.astype(np.uint64) << np.uint64(44))) | np.uint64(1)
            slot = (h >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)
            hit = self.keys[slot] == h
            got = self.values[:, slot]
            miss = np.flatnonzero(~hit)
            if len(miss):
                _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
                which = miss[first]
                texts = [points[start[i] : start[i] + length[i]].tobytes().decode("utf-32-le") for i in which]
                new = np.array([[len(c.encode_ordinary(x)) for x in texts] for c in self.codes], np.int32)
                got[:, miss] = new[:, back]
                _, one = np.unique(slot[which], return_index=True)  # of several for one slot, one is kept
                self.keys[slot[which[one]]] = h[which[one]]
                self.values[:, slot[which[one]]] = new[:, one]
            first_piece = np.searchsorted(start, rows)
            for k in range(len(self.codes)):
                out[k, a:b] = ragged_sum(got[k].astype(np.int64), first_piece)
        return out


@lru_cache(maxsize=4)
def counter(folder: str, names: tuple[str, ...]) -> Counter:
    return Counter(folder, names)

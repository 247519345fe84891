"""Walking one automaton over many texts at once.

Texts are cut into segments; all segments advance by one symbol per step, so
the work is a few array operations per step, not one Python step per symbol.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SEGMENT = 512


def segments(offsets: np.ndarray, length: int = SEGMENT, warm: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, row, warm-up symbols before) of each segment, longest first.

    ``start`` is where the warm-up begins and ``size`` counts it."""
    sizes = np.diff(offsets)
    per = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[row] + nth * length
    own = np.minimum(length, offsets[row + 1] - begin)
    before = np.minimum(warm, nth * length)
    order = np.argsort(-(own + before), kind="stable")
    return (begin - before)[order], (own + before)[order], row[order], before[order]


def walk(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, step: Callable[[int, int, np.ndarray], None]) -> None:
    """Call step(t, n, x) for each t: the first n segments read symbols x."""
    if len(size) == 0:
        return
    ascending = -size
    for t in range(int(size[0])):
        n = int(np.searchsorted(ascending, -t, side="left"))
        step(t, n, symbols[start[:n] + t])

"""Repeated windows of a text, from the run-compressed Burrows-Wheeler transform with sampled run ends.

Going through a text, the match that a suffix has with its neighbour in the suffix array loses its first byte
from each position to the next, except where the transform changes its byte: there a run ends and another
begins. So the matches sampled at the two ends of runs give the matching statistics of all
positions: a position's match reaches as far as that of the last sample before it. A repetitive text has few runs.
"""

from __future__ import annotations

import numpy as np

#: Ends each string of a collection; no byte of UTF-8.
END = 0xFE
#: Stands beyond the last string, so that no suffix that reaches it is like another; no byte of UTF-8 either.
BEYOND = 0xFF


def suffix_ranks(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array, and levels: the ranks of all positions by their first so many bytes, 8 at first.

    A level joins the ranks of three positions (two where three do not fit in a number), so that few sorts reach any length.
    """
    n = text.size
    padded = np.full(n + 8, BEYOND, np.uint8)
    padded[:n] = text
    first = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    bits = int(n).bit_length()
    joins = 3 if 3 * bits < 64 else 2
    ranks, step, levels = np.empty(n, np.int64), 8, []
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        levels.append((step, ranks.astype(np.int32)))
        alike = np.zeros(n, bool)
        same = ~new[1:]
        alike[1:] |= same
        alike[:-1] |= same
        todo = np.flatnonzero(alike)
        if not todo.size:
            return order, levels
        at = order[todo]
        padded_ranks = np.concatenate([ranks, np.full((joins - 1) * step, n, np.int64)])
        key = ranks[at]
        for k in range(1, joins):
            key = (key << bits) + padded_ranks[at + k * step]
        again = np.argsort(key, kind="stable")
        key = key[again]
        order[todo] = at[again]
        # a group keeps its places; its members get the place at which their own part of it begins
        new[todo] = split = np.concatenate([[True], key[1:] != key[:-1]])
        ranks = ranks.copy()
        ranks[order[todo]] = np.maximum.accumulate(np.where(split, todo, 0))
        step *= joins


def common_prefix(a: np.ndarray, b: np.ndarray, text: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many bytes the suffixes at a and b (two different ones each) share."""
    n, a, b, out = text.size, a.copy(), b.copy(), np.zeros(a.size, np.int64)
    for step, ranks in [*levels[::-1], (1, text)]:
        while True:  # a longer level would have told if more than a few steps of this one fitted
            ok = (a < n) & (b < n)
            ok[ok] = ranks[a[ok]] == ranks[b[ok]]
            if not ok.any():
                break
            for x in (a, b, out):
                x[ok] += step
    return out


def repeated_windows(text: np.ndarray, window: int) -> np.ndarray:
    """For strings that END each: whether the window that starts at a position lies in one string and also starts elsewhere."""
    n = text.size
    if n <= window:
        return np.zeros(n, bool)
    order, levels = suffix_ranks(text)
    last = np.where(order > 0, text[order - 1], -1).astype(np.int16)  # the transform; the whole text's own row is a run
    head = np.flatnonzero(last[1:] != last[:-1]) + 1  # first rows of runs; the row before each ends one
    above, below = order[head - 1], order[head]
    _, ranks = max((x for x in levels if x[0] <= window), key=lambda x: x[0], default=(0, np.zeros(n)))
    long = ranks[above] == ranks[below]  # the others share fewer bytes than a window has
    above, below = above[long], below[long]
    match = common_prefix(above, below, text, levels)
    good = match >= window
    marks = np.zeros(n + 1, np.int64)
    for at in (above[good], below[good]):
        np.add.at(marks, at, 1)
        np.add.at(marks, at + match[good] - window + 1, -1)
    ends = np.flatnonzero(text == END)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    return (np.cumsum(marks[:n]) > 0) & (left >= window)

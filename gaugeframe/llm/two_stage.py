"""Suffix sorting in two stages, to a bounded depth, for many short regions at once.

A suffix smaller than its successor is sorted directly; every other one is
induced: scanning the sorted suffixes by first byte, each puts its predecessor,
if that is larger than it, at the next place of the predecessor's byte.  The
scan goes a byte at a time, all suffixes of that byte together; runs of one
byte take a round for each length.
"""

from __future__ import annotations

import numpy as np


def _direct(text: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes ``at`` by their first ``depth`` bytes; past ``end`` counts as 0."""
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))  # places whose suffix still ties with a neighbour
    shifts = np.arange(8)
    for d in range(0, depth, 8):
        if not len(open_):
            break
        rows = order[open_]
        place = at[rows][:, None] + (d + shifts)
        inside = place < end[rows][:, None]
        inside &= d + shifts < depth
        word = np.where(inside, text[np.minimum(place, len(text) - 1)], 0).astype(np.uint8)
        key = np.ascontiguousarray(word).view(">u8").ravel().astype(np.uint64)
        g = group[open_]
        sort = np.lexsort((key, g))
        order[open_] = rows[sort]
        key, g = key[sort], g[sort]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group[open_] = np.cumsum(new) - 1 + (int(group.max()) + 1)  # new numbers, in order inside each old group
        tie = ~new
        tie[:-1] |= ~new[1:]
        open_ = open_[tie]
    return order


def suffix_order(text: np.ndarray, begin: np.ndarray, starts: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The first ``starts[k]`` suffixes of every region, sorted to ``depth`` bytes.

    Regions are ``text[begin[k]:end[k]]``, one after another.  Returns positions.
    """
    n = len(text)
    region = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(n)
    last = at == end[region] - 1
    # sign of the step to the next different byte; the end of a region counts as a rise
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[last] = 1
    known = np.where(step != 0, at, n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[known] > 0
    wanted = at - begin[region] < starts[region]
    # what is induced needs its successors up to one that is sorted directly
    next_small = np.minimum.accumulate(np.where(smaller, at, n)[::-1])[::-1]
    reach = np.maximum.reduceat(np.where(wanted, next_small, 0), begin)
    used = at <= reach[region]
    small = np.flatnonzero(used & smaller)
    small = small[_direct(text, small, end[region[small]], depth)]
    by_byte = np.argsort(text[small], kind="stable")
    small = small[by_byte]
    small_cut = np.searchsorted(text[small], np.arange(257))
    large = used & ~smaller
    waiting: dict[int, list[np.ndarray]] = {}
    out = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Deals the predecessors of ``found`` to their bytes; those of the same byte come back."""
        before = found[found > begin[region[found]]] - 1
        before = before[large[before]]
        first = text[before]
        same = before[first == byte]
        other, first = before[first != byte], first[first != byte]
        sort = np.argsort(first, kind="stable")
        other, first = other[sort], first[sort]
        cut = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(other, cut):
            if len(part):
                waiting.setdefault(int(text[part[0]]), []).append(part)
        return same

    for byte in range(256):
        # larger-than-successor suffixes of this byte come first, shortest run first
        fresh = waiting.pop(byte, [])
        found = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
        while len(found):
            out.append(found)
            found = induce(found, byte)
        found = small[small_cut[byte] : small_cut[byte + 1]]
        if len(found):
            out.append(found)
            induce(found, byte)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, to ``depth`` at most.

    Every suffix must have ``depth`` bytes.
    """
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        if not len(live):
            break
        width = min(8, depth - d)
        place = np.arange(d, d + width)
        same = text[order[live][:, None] + place] == text[order[live - 1][:, None] + place]
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[live] += run
        live = live[run == width]
    return out

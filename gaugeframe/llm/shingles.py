"""Word shingles as 64-bit hashes, for many texts at once in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import common

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_IS_WORD = np.array([b != 32 for b in common.WORD_BYTES], bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads their bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2**64; one pair of arrays is kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS.append(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words of each text."""
    joined = b" ".join(texts).translate(common.WORD_BYTES)
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.concatenate([[False], raw != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    n = 1 << max(10, int(len(raw) - 1).bit_length())
    power, inverse = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.searchsorted(begin, starts)
    return hashes, np.diff(at)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and how many each text has.

    A text with fewer words than ``width`` but not none has one shingle of all of them.
    """
    hashes, counts = word_hashes(texts)
    n_docs = len(texts)
    doc = np.repeat(np.arange(n_docs), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    left = np.repeat(first[1:], counts) - np.arange(len(hashes))  # words from here to the text's end
    out = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        use = left > k
        moved = np.zeros(len(hashes), np.uint64)
        moved[: max(0, len(hashes) - k)] = hashes[k:]
        out = np.where(use, mix(out * np.uint64(0xD6E8FEB86659FD93) + moved), out)
    whole = left >= width
    whole[first[:-1][(counts > 0) & (counts < width)]] = True
    doc, out = doc[whole], out[whole]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    doc, out = doc[new], out[new]
    return out, np.bincount(doc, minlength=n_docs)


def set_keys(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each set whatever the order; None for an empty set."""
    if not len(values):
        return [None] * len(counts)
    full = counts > 0
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
    a = np.add.reduceat(mix(values + np.uint64(1)), starts)
    b = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    packed = np.stack([a, b], axis=1).astype("<u8").tobytes()
    keys = iter(packed[i : i + 16] for i in range(0, len(packed), 16))
    return [next(keys) if f else None for f in full]


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` min-hashes of 16 bits for each non-empty set."""
    full = counts > 0
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
    out = np.zeros((int(full.sum()), n), np.uint16)
    if not len(values):
        return out
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for k, m in enumerate(_multipliers(n)):
        x = low * m
        x ^= high
        x *= np.uint32(0x9E3779B1)
        least = np.minimum.reduceat(x, starts)
        out[:, k] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out

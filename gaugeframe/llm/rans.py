"""Token ids in shard files: a static range asymmetric numeral system.

A shard has one frequency table that all its blocks share.  A block holds
``BLOCK`` ids dealt over ``LANES`` interleaved coders; each block has a
checkpoint (payload offset, coder states) and a checksum, so any block can be
decoded alone and all of them at once.

Layout of a shard (little-endian): magic, version, counts, the documents
(start and length of each in the shard), the sorted symbols as gaps and their
frequencies, checkpoints, payload words, and a CRC-32 of everything before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"RANS", 1
BLOCK, LANES = 8192, 8
#: Bits of the frequency scale, and the lower bound of a coder's state.
SCALE, FLOOR = 20, np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIQQ")


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; every symbol keeps at least 1."""
    total = 1 << SCALE
    if len(counts) > total:
        raise ValueError(f"{len(counts)} symbols exceed the scale of {total}")
    freq = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    left = total - int(freq.sum())
    if left > 0:
        freq[int(np.argmax(freq))] += left
    while left < 0:  # take from the largest, never below 1
        order = np.argsort(-freq, kind="stable")
        take = np.minimum(freq[order] - 1, np.maximum(1, (freq[order] * -left) // total))
        cut = np.cumsum(take)
        take = np.where(cut <= -left, take, np.maximum(0, -left - (cut - take)))
        freq[order] -= take
        left = total - int(freq.sum())
    return freq


def encode(ids: np.ndarray, lengths: list[int]) -> bytes:
    """One shard of ``ids``; ``lengths`` are those of its documents."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) < 1 << 22:  # small ids: counting beats sorting
        tally = np.bincount(ids)
        symbols = np.flatnonzero(tally).astype(np.uint32)
        place = np.zeros(len(tally), np.int32)
        place[symbols] = np.arange(len(symbols), dtype=np.int32)
        inverse, counts = place[ids], tally[symbols]
    else:
        symbols, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    freq = _frequencies(counts) if n else np.zeros(0, np.int64)
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    f = freq.astype(np.uint64)
    steps = BLOCK // LANES
    # [step, block * lane], the last block padded and masked
    padded = np.zeros(n_blocks * BLOCK, np.int32)
    padded[:n] = inverse
    grid = padded.reshape(n_blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, -1)
    state = np.full(n_blocks * LANES, FLOOR, np.uint64)
    out = np.zeros((steps, n_blocks * LANES), np.uint32)
    sent = np.zeros((steps, n_blocks * LANES), bool)
    shift, word, top = np.uint64(SCALE), np.uint64(32), np.uint64(63 - SCALE)
    last = n - (n_blocks - 1) * BLOCK
    for t in range(steps - 1, -1, -1):
        live = slice(None)
        if n_blocks and last < BLOCK and (t + 1) * LANES > last:
            live = slice(0, (n_blocks - 1) * LANES + max(0, min(LANES, last - t * LANES)))
        s = grid[t, live]
        x, fs = state[live], f[s]
        full = x >= (fs << top)
        out[t, live] = np.where(full, x, 0).astype(np.uint32)
        sent[t, live] = full
        x = np.where(full, x >> word, x)
        q = x // fs
        state[live] = (q << shift) + (x - q * fs) + cum[s]
    words = out.reshape(steps, n_blocks, LANES).transpose(1, 0, 2)[sent.reshape(steps, n_blocks, LANES).transpose(1, 0, 2)]
    per_block = sent.reshape(steps, n_blocks, LANES).sum(axis=(0, 2))
    crcs = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(n_blocks)], dtype="<u4")
    body = b"".join(
        (
            _HEAD.pack(MAGIC, VERSION, LANES, len(lengths), len(symbols), n, len(words)),
            np.asarray(lengths, "<u8").tobytes(),
            np.diff(symbols, prepend=0).astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            np.concatenate([[0], np.cumsum(per_block)])[:n_blocks].astype("<u8").tobytes(),
            state.astype("<u8").tobytes(),
            crcs.tobytes(),
            words.astype("<u4").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard opened for reading; ``decode`` takes any range of its blocks."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("shard is cut off or damaged")
        magic, version, lanes, n_docs, n_symbols, self.n, n_words = _HEAD.unpack_from(data)
        if (magic, version, lanes) != (MAGIC, VERSION, LANES):
            raise ValueError("not a shard of this version")
        self.n_blocks = -(-self.n // BLOCK)
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.lengths = take("<u8", n_docs).astype(np.int64)
        self.symbols = np.cumsum(take("<u4", n_symbols).astype(np.uint64)).astype(np.uint32)
        self.freq = take("<u4", n_symbols).astype(np.uint64)
        self.offsets = take("<u8", self.n_blocks).astype(np.int64)
        self.states = take("<u8", self.n_blocks * LANES).astype(np.uint64)
        self.crcs = take("<u4", self.n_blocks)
        self.words = take("<u4", n_words)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)
        self.slots = np.repeat(np.arange(n_symbols, dtype=np.int32), self.freq.astype(np.int64)) if n_symbols else None

    def decode(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of blocks ``first`` to ``end``, each held against its checksum."""
        end = self.n_blocks if end is None else min(end, self.n_blocks)
        count = end - first
        if count <= 0:
            return np.zeros(0, np.uint32)
        steps = BLOCK // LANES
        x = self.states[first * LANES : end * LANES].copy()
        at = self.offsets[first:end].copy()
        found = np.zeros((steps, count * LANES), np.int32)
        last = self.n - (self.n_blocks - 1) * BLOCK if end == self.n_blocks else BLOCK
        words = np.append(self.words, np.zeros(LANES, np.uint32)).astype(np.uint64)
        mask, shift, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(steps):
            live = count * LANES
            if (t + 1) * LANES > last:
                live = (count - 1) * LANES + max(0, min(LANES, last - t * LANES))
                if not live:
                    break
            y = x[:live]
            slot = y & mask
            s = self.slots[slot.astype(np.int64)]
            found[t, :live] = s
            y = self.freq[s] * (y >> shift) + slot - self.cum[s]
            low = np.zeros(count * LANES, bool)
            low[:live] = y < FLOOR
            rank = low.reshape(count, LANES)
            before = np.cumsum(rank, axis=1)
            place = (at[:, None] + before - rank).reshape(-1)[:live]
            got = low[:live]
            y[got] = (y[got] << word) | words[place[got]]
            at += before[:, -1]
            x[:live] = y
        ids = self.symbols[found.reshape(steps, count, LANES).transpose(1, 0, 2).reshape(-1)[: (count - 1) * BLOCK + last]]
        for b in range(count):
            if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != self.crcs[first + b]:
                raise ValueError(f"block {first + b} is damaged")
        return ids

    def documents(self, blocks: int = 256):
        """The ids of one document after another, few blocks decoded at a time."""
        held, block, have = [], 0, 0
        for n in self.lengths.tolist():
            while have < n:
                held.append(self.decode(block, block + blocks))
                have += len(held[-1])
                block += blocks
            joined = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint32)
            yield joined[:n]
            held, have = [joined[n:]], have - n

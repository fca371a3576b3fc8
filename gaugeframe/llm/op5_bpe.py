"""BPE encoding and decoding: speculate by longest match, verify pairs, merge only what fails.

Greedy longest match proposes the tokens of every distinct piece of a batch.
A proposal is the exact encoding if no merge would ever cross the border of two
neighbours; that is tested for all adjacent pairs of the batch at once, by
undoing both tokens' merges from the latest to the earliest.  Pieces with a
failing pair go through exact merging.

``decode`` joins the tokens' strings with a space, as the library does for a
file without a decoder.  A null text is empty.  Very long texts are one row
each; a very long piece merges through a heap, in near linear time, and the
caches are bounded in bytes.  Repeated rows give repeated results.  Only doc_id
and text are read, whatever other columns there are.  A file with another
normalisation or splitting than the one built here is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vocab

#: Splitting of the vocabulary file, fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = np.int64(1) << 40
#: Symbols from which on a piece is merged through a heap, not beside others.
LONG = 64


class SpeculativeBpe:
    """Encoder and decoder for a word-end BPE file with merges in order of rank.

    A piece is its UTF-8 bytes read as Latin-1, so a character is a byte.
    """

    def __init__(self, path: str):
        spec = vocab.spec(path)
        vocab.check(spec, PIECES)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [""] * size
        for s, i in self.ids.items():
            self.strings[i] = s
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s
        self.raw = [s.encode() for s in self.strings]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(PIECES)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        #: How each token came about: the rank of its merge (-1: a single symbol) and the halves.
        self.born = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        for (a, b), (r, new) in self.rank.items():
            if self.born[new] < 0:
                self.born[new], self.left[new], self.right[new] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.key_rank = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.key_new = np.array([new for _, new in self.rank.values()], np.int64)[order]
        # tokens by the bytes they stand for: inside a word, and at its end
        byte_of = {c: chr(b) for b, c in enumerate(vocab.byte_alphabet())}
        spell = lambda s: "".join(map(byte_of.__getitem__, s))
        self.closed = {spell(s.removesuffix(self.end)): i for s, i in self.ids.items() if s.endswith(self.end)}
        self.plain = {spell(s): i for s, i in self.ids.items() if not s.endswith(self.end)}
        #: The longest token inside a word for each two first bytes.
        self.reach: dict[str, int] = {}
        for s in self.plain:
            self.reach[s[:2]] = max(len(s), self.reach.get(s[:2], 0))
        #: Whether merging a token's own symbols gives that token (-1: not tried yet).
        self.own = np.full(size, -1, np.int8)

    # -- exact merging -------------------------------------------------------
    def symbols(self, piece: str) -> list[int]:
        """The single symbols of a piece; the last carries the word end."""
        return [*map(self.plain.__getitem__, piece[:-1]), self.closed[piece[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left: a heap of pairs over a linked list."""
        ids, n, rank = list(ids), len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heap = [(r, i) for r, _, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            now = rank.get((ids[i], ids[j]))
            if now is None or now[0] != r:
                continue  # the pair has changed since
            ids[i], ids[j] = now[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (pair[0], i))
            h = before[i]
            if h >= 0 and (pair := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (pair[0], h))
        return [t for t in ids if t >= 0]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge_many(self, words: list[list[int]]) -> list[list[int]]:
        """``merge`` for many short words at once: every round merges the best pair of each word that has one."""
        out: list[list[int]] = [[]] * len(words)
        name = np.arange(len(words))
        count = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(chain.from_iterable(words), np.int64, int(count.sum()))
        found = np.full(len(ids), -1)  # merge of each symbol and the next one in its word
        found[:-1] = self._pair(ids[:-1], ids[1:])
        found[np.cumsum(count) - 1] = -1
        while len(name):
            start = np.cumsum(count) - count
            rank = np.where(found >= 0, self.key_rank[found], _NONE)
            best = np.minimum.reduceat((rank << 22) | np.arange(len(ids)), start)
            done = best >> 22 >= _NONE
            for w, a, n in zip(name[done].tolist(), start[done].tolist(), count[done].tolist(), strict=True):
                out[w] = ids[a : a + n].tolist()
            at = best[~done] & ((1 << 22) - 1)
            ids[at] = self.key_new[found[at]]
            last = at + 1 == (start + count - 1)[~done]  # the pair ends its word
            stay = np.repeat(~done, count)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            first = at == start[~done]
            name, count = name[~done], count[~done] - 1
            ids, found, at = ids[stay], found[stay], moved[at]
            found[at[last]] = -1
            right, left = at[~last], at[~first]
            found[right] = self._pair(ids[right], ids[right + 1])
            found[left - 1] = self._pair(ids[left - 1], ids[left])
        return out

    # -- speculation ---------------------------------------------------------
    def propose(self, piece: str) -> list[int] | None:
        """Greedy longest match from the left; None where no token fits."""
        closed, plain, reach, n = self.closed, self.plain, self.reach, len(piece)
        found, i = [], 0
        while True:
            t = closed.get(piece[i:])
            if t is not None:
                found.append(t)
                return found
            j = min(n - 1, i + reach.get(piece[i : i + 2], 1))
            while j > i and (t := plain.get(piece[i:j])) is None:
                j -= 1
            if j <= i:
                return None
            found.append(t)
            i = j

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does encoding their joined strings give just the two?"""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        #: Merges of a rank below it come before the step that has been undone last.
        limit = np.full(len(a), _NONE)
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            at = self._pair(x, y)
            rank = np.where(at >= 0, self.key_rank[at], _NONE)
            bad = rank < top
            good[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            stay = ~bad & ((bx >= 0) | (by >= 0))
            # undo the later merge; of equal rank the right one, since merging goes from the left
            undo_left = bx > by
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            # a crossing merge of equal rank goes before one to its right, and after one to its left
            limit[live] = np.where(undo_left, bx, by + 1)
            live = live[stay]
        return good

    def reachable(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging each token's own symbols gives that token."""
        for t in np.unique(tokens[self.own[tokens] < 0]).tolist():
            s = self.strings[t]
            end = s.endswith(self.end)
            chars = s.removesuffix(self.end)
            ids = [self.ids[c] for c in chars]
            if end:
                ids[-1:] = [self.ids[chars[-1] + self.end]]
            self.own[t] = self.merge(ids) == [t]
        return self.own[tokens] > 0

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Exact encodings of pieces."""
        found = [self.propose(p) for p in pieces]
        flat = np.fromiter(chain.from_iterable(f for f in found if f), np.int64)
        of = np.repeat(np.arange(len(found)), [len(f) if f else 0 for f in found])
        failed = {i for i, f in enumerate(found) if f is None}
        failed.update(of[~self.reachable(flat)].tolist())
        pair = np.flatnonzero(of[1:] == of[:-1])
        keys, back = np.unique(flat[pair] * self.size + flat[pair + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[back]
        failed.update(of[pair[~good]].tolist())
        short = [i for i in failed if len(pieces[i]) <= LONG]
        for k in range(0, len(short), 1 << 15):
            some = short[k : k + (1 << 15)]
            for i, ids in zip(some, self.merge_many([self.symbols(pieces[i]) for i in some]), strict=True):
                found[i] = ids
        for i in failed.difference(short):
            found[i] = self.merge(self.symbols(pieces[i]))
        return found

    # -- texts ---------------------------------------------------------------
    def pieces(self, chunk: str) -> list[str | int]:
        """Pieces of a text; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.special_split.split(chunk) if self.special_split else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                out += [m.encode().decode("latin-1") for m in self.split.findall(norm)]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text."""
        return b" ".join(map(self.raw.__getitem__, ids))


#: Bytes that a worker's younger half of remembered chunks may take, and bytes of text it cuts up at once.
REMEMBERED, SLICE_BYTES = 40 << 20, 1 << 20
#: What an entry takes beside its strings' own bytes.
_ENTRY = 180


class Aged(dict):
    """A dict of bytes in two halves, the younger of which is this dict.

    What is used again moves to the younger half; when that passes ``limit``
    bytes it becomes the older one and what only the older one had is gone.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size, self.old = limit, 0, {}

    def add(self, key, value: bytes) -> None:
        self[key] = value
        self.size += _ENTRY + len(key) + len(value)

    def age(self) -> None:
        """To be called between batches, so that a batch finds all it has added."""
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0

    def recall(self, keys: set) -> list:
        """Brings ``keys`` to the younger half; those that neither half has come back."""
        missing, old = [], self.old
        for k in keys.difference(self):
            value = old.get(k)
            if value is None:
                missing.append(k)
            else:
                self.add(k, value)
        return missing


class Chunks(Aged):
    """chunk without white space -> packed ids, learnt a batch at a time."""

    def __init__(self, bpe: SpeculativeBpe, limit: int = REMEMBERED):
        super().__init__(limit)
        self.bpe, self.parts = bpe, Aged(limit)

    def learn(self, chunks: set[bytes]) -> None:
        self.age()
        self.parts.age()
        cut, ask = [], set()
        for c in self.recall(chunks):
            m = vocab.SIMPLE.fullmatch(c)
            if m is None:
                parts = self.bpe.pieces(c.decode())
                ask.update(p for p in parts if isinstance(p, str))
            else:
                before, letters, after = m.groups()
                letters = letters.translate(vocab.LOWER).decode("latin-1")
                if before or after:
                    parts = [p for p in (before.decode("latin-1"), letters, after.decode("latin-1")) if p]
                    ask.update(parts)
                else:
                    parts = [letters]
                    ask.add(letters)
            cut.append((c, parts))
        own = self.parts
        pieces = own.recall(ask)
        for p, ids in zip(pieces, self.bpe.encode_pieces(pieces), strict=True):
            own.add(p, vocab.pack(ids))
        for c, parts in cut:
            self.add(c, own[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else b"".join([own[p] if isinstance(p, str) else vocab.pack([p]) for p in parts]))


_CHUNKS: dict[str, Chunks] = {}


def _chunks(path: str) -> Chunks:
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(SpeculativeBpe(path))
    return _CHUNKS[path]


def packed_texts(batch: pa.RecordBatch, column: str, path: str):
    """(rows, packed ids of each text) for slices of a batch."""
    cache = _chunks(path)
    for rows in common.slices(batch, column, SLICE_BYTES):
        words = [t.split() for t in common.utf8(rows.column(column))]
        cache.learn(set().union(*words))
        yield rows, [b"".join(map(cache.__getitem__, w)) for w in words]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every text of ``docs``."""
    path = path or vocab.default_path()

    def step(batches):
        for batch in batches:
            for rows, packed in packed_texts(batch, "text", path):
                ids = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids], names=["doc_id", "ids"])

    return common.map_batches(_rows(docs), step, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of every row of ids."""
    path = path or vocab.default_path()

    def step(batches):
        bpe = _chunks(path).bpe
        for batch in batches:
            texts = pa.array([bpe.decode(x or []).decode() for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return common.map_batches(tokens.select("doc_id", "ids"), step, "doc_id long, text string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids and of what they decode to, for every text of ``docs``."""
    path = path or vocab.default_path()

    def step(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in batches:
            for rows, packed in packed_texts(batch, "text", path):
                bpe = _chunks(path).bpe
                out = [
                    (len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(bpe.decode(np.frombuffer(p, "<u4").tolist())).hexdigest())
                    for p in packed
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], schema=schema)

    return common.map_batches(_rows(docs), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    return round_trip(common.table(spark, sf_dir, "documents"))

r"""Benchmark decontamination: a suffix automaton of all test items, streamed over by the documents.

Items and documents are cut into words (A-Z lower-cased, class
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``).  A window is ``window`` consecutive words of an
item; an item with fewer words is one window.  One generalised suffix
automaton holds all items of a block; a document's words run through it, and
wherever the longest match reaches a window's length, the window's words are
hit and its items noted.

Before that, a vectorised gate keeps only stretches in which every two
neighbours are neighbours in some item too, which no match can do without.

The items go to the executors in blocks of about ``block_bytes`` of text, one
automaton in flat arrays each (some 20 bytes of memory a byte of text), so what
one step broadcasts is bounded; with more blocks the documents pass several
automata, without a shuffle.  The driver holds the items of two blocks and one
automaton at a time.  Items without an id cannot be named and are ignored, as
are items without words.  A null text has no words.  Repeated rows are judged
each for itself; rows with the same item_id are one item.  Columns of documents
stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Bytes of item text in one automaton.
BLOCK_BYTES = 2 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(common.WORD_BYTES).split()


class _Builder:
    """A suffix automaton while it grows: one dict of transitions a state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def extend(self, last: int, t: int) -> int:
        """The state of a word after the state ``last`` of an item."""
        if t in self.next[last]:
            q = self.next[last][t]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, t, q)
        cur = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, t, q)
        return cur

    def _clone(self, p: int, t: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = new
            p = self.link[p]
        return new


class ItemAutomaton:
    """Generalised suffix automaton of items; states know the windows that end in them.

    A state's transitions are a stretch of two flat arrays, sorted by word.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.shortest = window
        grown, known, pairs = _Builder(), [], []
        for name, item in items:
            if not item:
                continue
            ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in item])
            last = 0
            for t in ids:
                last = grown.extend(last, t)
            known.append((name, ids))
            flat = np.array(ids, np.int64)
            pairs.append((flat[:-1] << 32) | flat[1:])
            self.shortest = min(self.shortest, len(ids))
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.link, self.length = grown.link, grown.length
        self.first, self.word, self.to = array("i", [0]), array("i"), array("i")
        for s, moves in enumerate(grown.next):
            for t in sorted(moves):
                self.word.append(t)
                self.to.append(moves[t])
            self.first.append(len(self.word))
            grown.next[s] = None
        self._note(known)

    def _note(self, known: list[tuple[str, array]]) -> None:
        """The state of each window, now that no state is cloned any more."""
        self.full: dict[int, set[str]] = {}
        short: dict[int, tuple[int, set[str]]] = {}
        for name, ids in known:
            if len(ids) < self.window:
                *_, (state, _) = self._walk(ids)
                short.setdefault(state, (len(ids), set()))[1].add(name)
                continue
            for state, length in self._walk(ids):
                if length >= self.window:
                    self.full.setdefault(self._cut(state), set()).add(name)
        #: For states with any: the short items that end wherever it is reached, longest first.
        self.short: dict[int, tuple] = {}
        if short:
            for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                above = self.short.get(self.link[s], ())
                here = ((*short[s], s), *above) if s in short else above
                if here:
                    self.short[s] = here

    def _step(self, state: int, t: int) -> int:
        """Where a word leads, or -1."""
        low, high = self.first[state], self.first[state + 1]
        at = bisect_left(self.word, t, low, high)
        return self.to[at] if at < high and self.word[at] == t else -1

    def _walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        state = length = 0
        for t in ids:
            to = self._step(state, t)
            while state and to < 0:
                state = self.link[state]
                length = self.length[state]
                to = self._step(state, t)
            if to >= 0:
                state, length = to, length + 1
            yield state, length

    def _cut(self, state: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches [from, to) of known words whose neighbours are neighbours in items."""
        if len(ids) < self.shortest:
            return
        known = ids >= 0
        if self.shortest == 1:
            joined = known[1:] & known[:-1]
        else:
            joined = np.zeros(max(0, len(ids) - 1), bool)
            at = np.flatnonzero(known[1:] & known[:-1])
            if len(at) and len(self.pairs):
                key = (ids[at].astype(np.int64) << 32) | ids[at + 1]
                place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                joined[at] = self.pairs[place] == key
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2] + 1
        fit = end - begin >= self.shortest
        yield from zip(begin[fit].tolist(), end[fit].tolist(), strict=True)
        if self.shortest == 1:
            alone = known.copy()
            alone[1:] &= ~joined
            alone[:-1] &= ~joined
            yield from ((i, i + 1) for i in np.flatnonzero(alone).tolist())

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (sorted, disjoint) and the items whose windows occur."""
        spans, found, seen = [], set(), set()
        for begin, end in self.stretches(ids):
            for i, (state, length) in enumerate(self._walk(ids[begin:end].tolist()), begin + 1):
                if length >= self.window:
                    state = self._cut(state)
                    spans.append((i - self.window, i))
                    if state not in seen:
                        seen.add(state)
                        found |= self.full.get(state, set())
                # a short item is hit if the match is as long as the item
                for n, names, _ in self.short.get(state, ()):
                    if n <= length:
                        spans.append((i - n, i))
                        found |= names
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks; the driver holds one block and one partition at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row.item_id, words(row.text.encode())))
        size += len(row.text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def find_hits(docs: DataFrame, benchmark: DataFrame, finish, schema: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What ``finish`` makes of every batch of ``docs`` and its hits, as rows of ``schema``.

    ``finish(batch, n_words, spans, items)`` gets the columns of ``docs``, which needs
    ``text``, and for every row its number of words, the spans of hit words of
    each block, and the items found.  It runs in the worker of the last block.
    """
    spark = docs.sparkSession
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    had, found = common.fresh(docs, "spans_before"), common.fresh(docs, "items_before")
    between = ", ".join([*fields, f"`{had}` array<struct<begin:int,end:int>>", f"`{found}` array<string>"])
    names, out, later = docs.columns, docs, blocks(benchmark, block_bytes)
    block, number = next(later, []), 0
    while block is not None:
        after = next(later, None)
        shared = spark.sparkContext.broadcast(ItemAutomaton(block, window))

        def step(batches, shared=shared, first=number == 0, end=finish if after is None else None):
            machine = shared.value
            get, none = machine.vocab.get, repeat(-1)
            for batch in batches:
                for rows in common.slices(batch, "text"):
                    counts, n = [], rows.num_rows
                    spans = [[] for _ in range(n)] if first else rows.column(had).to_pylist()
                    items = [set() for _ in range(n)] if first else [set(x) for x in rows.column(found).to_pylist()]
                    for k, text in enumerate(common.utf8(rows.column("text"))):
                        cut = words(text)
                        counts.append(len(cut))
                        hit, names_ = machine.hits(np.fromiter(map(get, cut, none), np.int64, len(cut)))
                        spans[k] += [{"begin": a, "end": b} for a, b in hit]
                        items[k] |= names_
                    own = rows.select(names)
                    if end:
                        yield end(own, counts, spans, items)
                    else:
                        more = [pa.array(spans, _SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*names, had, found])

        out = common.map_batches(out, step, schema if after is None else between)
        block, number = after, number + 1
    return out


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted((s["begin"], s["end"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, hit words, items found, and whether it is contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def digest(batch: pa.RecordBatch, counts, spans, items) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in _union(s)) for s in spans]
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        n = [len(x) for x in items]
        columns = [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array([x >= min_items for x in n], pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    return find_hits(rows, benchmark, digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", window, block_bytes)


def _word_ends(text: str) -> list[tuple[int, int]]:
    """Character offsets of every word of a text."""
    import re

    return [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def clean(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.5, min_items: int = 2, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without their hit spans; contaminated ones are dropped.

    A document goes if windows of ``min_items`` items or more occur in it, or
    if more than ``max_hit_share`` of its words are hit.  From the others the
    hit words go, with what stands between them; all columns stay, and n_chars
    is counted anew where it exists.
    """
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batch: pa.RecordBatch, counts, found_spans, found_items) -> pa.RecordBatch:
        keep, texts = [], []
        for text, n, spans, items in zip(batch.column("text").to_pylist(), counts, found_spans, found_items, strict=True):
            merged = _union(spans)
            hit = sum(b - a for a, b in merged)
            keep.append(len(items) < min_items and hit <= max_hit_share * n)
            if merged and keep[-1]:
                ends = _word_ends(text)
                for a, b in reversed(merged):
                    text = text[: ends[a][0]] + text[ends[b - 1][1] :]
            texts.append(text)
        new = {"text": pa.array(texts, batch.schema.field("text").type)}
        if "n_chars" in names:
            new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)
        return out.filter(pa.array(keep, pa.bool_()))

    return find_hits(docs, benchmark, cut, fields, window, block_bytes)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SPLIT} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT k, m, p, array_to_string(w[p:p + m - 1], ' ') AS s
       FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
h AS (SELECT k, p, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s),
hw AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT k, p, m FROM h)) GROUP BY k),
hi AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE C) AS s FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (k) LEFT JOIN hi USING (k)
""".replace(" COLLATE C", "")

"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts elsewhere go.

Every window of ``LENGTH`` bytes chooses one anchor: the ``GRAM``-byte string in it
with the least hash, the leftmost of equals.  Equal windows choose equal
anchors at equal places, so windows with different anchors need never meet.
Consecutive windows of a text with one anchor make a segment.

1. Segments whose anchor stands alone go at once.  The others are counted by
   anchor and content (192 bits of hashes).  Of a content that occurs twice,
   all windows are repeats; one of its occurrences stands for it from here on.
2. Under an anchor with several contents, of which one occurs once, the
   contents' bytes are fetched and suffix-sorted in two stages (``two_stage``);
   adjacent common prefixes of ``LENGTH`` bytes tell the repeats.
3. An anchor with more than ``CROWD`` contents is first split by the bytes around it
   (``split``): windows that begin far before it by the bytes before, the others
   by the bytes behind, all of which they hold.  Equal windows stay together,
   equal parts become one, and the halves are split again until no group is
   crowded; at the eighth split a group is one string.  So the same sorting
   serves every size, with bounded groups.
4. Repeats of a text are joined to it, and the rest of its bytes stays.

A row is known by its doc_id and a hash of its text.
Texts are UTF-8 bytes, null is empty; matches never cross documents; windows
overlap freely; the input is judged, not what is left of it.  Repeated rows are
documents that repeat each other.  Texts below ``LENGTH`` bytes lose nothing.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles, two_stage
from .components import spread_join

LENGTH, GRAM = 200, 32
#: Contents of a group that are sorted together, and bytes sorted at once.
CROWD, CELL_BYTES = 2048, 2 << 20
#: Bytes of a text that are hashed together, and bits of a place among them.
PIECE, _PLACE = 4 << 20, 24


#: Values of the bytes for a second hash beside the first.
_OTHER = shingles.mix(np.arange(1, 257, dtype=np.uint64))


def _prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rows of sums of which any substring's hash is a difference, and the inverse powers that place it."""
    n = 1 << max(12, int(max(1, len(raw) - 1)).bit_length())
    power, inverse = shingles._powers(n)
    total, other = (np.zeros(len(raw) + 1, np.uint64) for _ in range(2))
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64, out=total[1:])
    np.cumsum(_OTHER[raw] * power[: len(raw)], dtype=np.uint64, out=other[1:])
    return total, other, inverse


def _hashes(total: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return shingles.mix((total[end] - total[begin]) * inverse[begin])


def segments(texts: list[bytes], piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, start, windows, place of the anchor from the start, anchor hash, two content hashes) of every segment of the texts.

    A longer text is cut in pieces that share LENGTH - 1 bytes, so each window is
    in one of them; a segment that is cut is two contents, which sorting compares.
    """
    cut = [(i, k) for i, t in enumerate(texts) for k in range(0, max(1, len(t) - LENGTH + 1), piece)]
    of, start, *rest = _segments([texts[i][k : k + piece + LENGTH - 1] if len(texts[i]) > piece else texts[i] for i, k in cut])
    at = np.array(cut, np.int64).reshape(-1, 2)
    return at[of, 0], start + at[of, 1], *rest


def _segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if sum(map(len, texts)) >= 1 << _PLACE:
        parts = [_segments([t]) for t in texts]
        return (np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts]), *(np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]))
    long_ = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not long_:
        return none
    raw = np.frombuffer(b"".join(texts[i] for i in long_), np.uint8)
    sizes = np.array([len(texts[i]) for i in long_], np.int64)
    begin = np.cumsum(sizes) - sizes
    total, other, inverse = _prefix_hash(raw)
    n = len(raw)
    at = np.arange(n - GRAM + 1)
    gram = _hashes(total, inverse, at, at + GRAM)
    least = (gram >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at.astype(np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    # windows inside a text
    counts = sizes - LENGTH + 1
    doc = np.repeat(np.arange(len(long_)), counts)
    first = np.cumsum(counts) - counts
    window = np.arange(len(doc)) - first[doc] + begin[doc]
    chosen = (least[window] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(doc)))
    start, place = window[head], chosen[head]
    end = start + many - 1 + LENGTH
    mark = (place - start).astype(np.uint64) * np.uint64(1 << 32) + many.astype(np.uint64)
    content = [shingles.mix(_hashes(x, inverse, start, end) + mark).view(np.int64) for x in (total, other)]
    of = doc[head]
    return np.array(long_)[of], start - begin[of], many, place - start, gram[place].view(np.int64), *content


#: The columns that name a row, and those that name a content.
ROW, CONTENT = ["doc", "h"], ["anchor", "c1", "c2"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), and the row's name; without a doc_id more of the text's hash takes its place."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.hash("text").cast("long")), "h": F.xxhash64("text", F.col("doc_id").isNull())})


def _segment_rows(rows: DataFrame) -> DataFrame:
    """One row a segment; ``place`` holds its start, windows and the anchor's place, in 16 low bits the latter two."""

    def step(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                of, start, many, at, anchor, c1, c2 = segments(common.utf8(part.column("text")))
                own = [part.column(c).take(pa.array(of)) for c in ROW]
                columns = [pa.array(anchor), pa.array(c1), pa.array(c2), *own, pa.array((start << 16) | (many << 8) | at)]
                yield pa.RecordBatch.from_arrays(columns, names=[*CONTENT, *ROW, "place"])

    return common.map_batches(rows.select(*ROW, "text"), step, "anchor long, c1 long, c2 long, doc long, h long, place long")


def _start():
    return F.shiftright("place", 16)


def _windows():
    return F.shiftright("place", 8).bitwiseAND(F.lit(255))


_PARTS = pa.schema([("cell", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("once", pa.bool_()), ("data", pa.binary())])
_PARTS_SQL = "cell long, doc long, h long, start long, windows int, at int, low int, high int, once boolean, data binary"


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTS.types, strict=True)], schema=_PARTS)


def _fetch(batches):
    """The bytes of the listed segments of each text."""
    for batch in batches:
        out, size = [], 0
        for text, doc, h, wanted in zip(common.utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in (*ROW, "wanted")), strict=True):
            for w in wanted:
                start, many, at = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                out.append((w["anchor"], doc, h, start, many, at, 0, LENGTH - GRAM, w["once"], text[start : start + many - 1 + LENGTH]))
                size += LENGTH + many
            if size > common.BATCH_BYTES:
                yield _part_batch(out)
                out, size = [], 0
        if out:
            yield _part_batch(out)


def split(cell: int, at: int, windows: int, low: int, high: int, data: bytes):
    """(cell, first window, windows, low, high) of the halves of one part of a crowded group.

    Window k holds the anchor at ``at - k``, and all windows of the group hold it
    from ``low`` to ``high``.  Those that hold it at ``mid`` or later share the
    ``mid`` bytes before it; the others share those behind it up to the end of the
    last of them.  A half's cell is a digest of all the bytes its windows share.
    """
    mid = (low + high + 1) // 2
    for a, b in ((mid, high), (low, mid - 1)):
        first, last = max(0, at - b), min(windows - 1, at - a)
        if first <= last:
            shared = data[at - a : at - b + LENGTH]
            name = hashlib.blake2b(b"%d %d %d " % (cell, a, b) + shared, digest_size=8).digest()
            yield int.from_bytes(name, "little", signed=True), first, last - first + 1, a, b


def _halves(batches):
    """The halves of every part of a crowded group."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for cell, first, many, low, high in split(r["cell"], r["at"], r["windows"], r["low"], r["high"], r["data"]):
                out.append((cell, r["doc"], r["h"], r["start"] + first, many, r["at"] - first, low, high, r["once"], r["data"][first : first + many - 1 + LENGTH]))
        if out:
            yield _part_batch(out)


_SPANS = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def repeats(data: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Which windows of the segments equal another window among them, segment after segment."""
    text = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data], np.int64)
    begin = np.cumsum(sizes) - sizes
    order = two_stage.suffix_order(text, begin, windows, begin + sizes, LENGTH)
    full = two_stage.common_prefixes(text, order, LENGTH) >= LENGTH
    twice = full.copy()
    twice[:-1] |= full[1:]
    out = np.zeros(len(text), bool)
    out[order[twice]] = True
    first = np.cumsum(windows) - windows
    return out[np.repeat(begin - first, windows) + np.arange(int(windows.sum()))]


def _runs(flags: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, last window) of the runs of flagged windows in each segment."""
    seg = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(flags)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (seg[at[1:]] != seg[at[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return seg[at[head]], inside[at[head]], inside[at[tail]]


def _sort_cells(batches):
    """Sorts whole groups together, some at a time, and gives the repeats of contents that occur once."""

    def done(rows):
        data = [r["data"] for r in rows]
        windows = np.array([r["windows"] for r in rows], np.int64)
        seg, a, b = _runs(repeats(data, windows), windows)
        out = [(rows[s]["doc"], rows[s]["h"], rows[s]["start"] + x, rows[s]["start"] + y + LENGTH) for s, x, y in zip(seg.tolist(), a.tolist(), b.tolist(), strict=True) if rows[s]["once"]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_SPANS)

    held, size = [], 0
    for batch in batches:
        for row in batch.select(["cell", "doc", "h", "start", "windows", "once", "data"]).to_pylist():
            if size >= CELL_BYTES and row["cell"] != held[-1]["cell"]:
                yield from done(held)
                held, size = [], 0
            held.append(row)
            size += len(row["data"])
    if held:
        yield from done(held)


def _small_groups(parts: DataFrame, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """Parts in groups of at most ``crowd`` with something to find, and the spans found on the way."""
    spark, small, spans = parts.sparkSession, [], []
    while True:
        sizes = parts.groupBy("cell").agg(F.count("*").alias("m"))
        small.append(parts.join(sizes.where(f"m <= {crowd}").select("cell"), "cell", "left_semi"))
        crowded = sizes.where(f"m > {crowd}")
        if crowded.isEmpty():
            break
        total = parts.count()
        halves = common.materialise(spark, common.map_batches(spread_join(parts, crowded, "cell", [*ROW, "start"], "m", total), _halves, _PARTS_SQL))
        halves = halves.withColumn("content", F.sha2("data", 256))
        # equal halves are repeats of each other; one stands for them
        equal = halves.groupBy("cell", "content").agg(F.count("*").alias("n"), F.min(F.struct(*_PARTS.names[1:-1], "data")).alias("one"))
        equal = common.materialise(spark, equal)
        twice = equal.where("n > 1").select("cell", "content", "n")
        spans.append(spread_join(halves.where("once").drop("data"), twice, ["cell", "content"], [*ROW, "start"], "n", 2 * total).selectExpr("doc", "h", "start AS begin", f"start + windows - 1 + {LENGTH} AS end"))
        once = F.when(F.col("n") > 1, False).otherwise(F.col("one.once")).alias("once")
        parts = equal.select("cell", *[once if c == "once" else F.col(f"one.{c}").alias(c) for c in _PARTS.names[1:]])
        parts = common.materialise(spark, _with_something(parts))
    return _union(small), spans


def _with_something(parts: DataFrame) -> DataFrame:
    """Parts of groups that hold several of which one occurs once: all others have nothing to find."""
    live = parts.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("once").alias("lone")).where("m > 1 AND lone > 0").select("cell")
    return parts.join(live, "cell", "left_semi")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repeated_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc, h, begin, end: bytes of each different row (see ``_rows``) that repeated windows cover; spans may overlap."""
    spark = docs.sparkSession
    rows = _rows(docs)
    every = common.materialise(spark, _segment_rows(rows))
    total = every.count()
    shared = common.materialise(spark, every.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"))
    segs = common.materialise(spark, spread_join(every, shared, "anchor", ["c1", *ROW, "place"], "m", total, "left_semi"))
    contents = segs.groupBy(*CONTENT).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("rep"))
    contents = common.materialise(spark, contents)
    whole = spread_join(segs, contents.where("n > 1").select(*CONTENT, "n"), CONTENT, [*ROW, "place"], "n", total, "left_semi")
    spans = whole.select(*ROW, _start().alias("begin"), (_start() + _windows() - 1 + LENGTH).alias("end"))
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("lone")).where("m > 1 AND lone > 0").select("anchor", "m")
    wanted = spread_join(contents, anchors, "anchor", ["c1", "c2"], "m", total, "left_semi").select(F.col("rep.doc").alias("doc"), F.col("rep.h").alias("h"), F.struct("anchor", F.col("rep.place").alias("place"), (F.col("n") == 1).alias("once")).alias("w"))
    wanted = wanted.groupBy(*ROW).agg(F.collect_list("w").alias("wanted"))
    parts = common.materialise(spark, common.map_batches(rows.select(*ROW, "text").join(wanted, ROW), _fetch, _PARTS_SQL))
    small, found = _small_groups(parts, crowd)
    cells = small.repartition("cell").sortWithinPartitions("cell")
    return _union([spans, common.map_batches(cells, _sort_cells, "doc long, h long, begin long, end long"), *found])


def merge_spans(begin: list[int], end: list[int]) -> list[tuple[int, int]]:
    """Union of spans, sorted; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans (begin, end) that go, and the bytes that stay."""
    return _joined(docs, crowd, _kept, "doc_id long, n_bytes long, spans array<struct<begin:bigint,end:bigint>>, kept binary")


def _joined(docs: DataFrame, crowd: int, step, schema: str) -> DataFrame:
    spans = repeated_spans(docs, crowd).groupBy(*ROW).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    rows = _rows(docs).join(spans, ROW, "left").select("doc_id", "text", "spans")
    return common.map_batches(rows, step, schema)


def _cut(batch):
    for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), common.utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
        merged = merge_spans([s["begin"] for s in spans or ()], [s["end"] for s in spans or ()])
        at, kept = 0, []
        for a, b in merged:
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        yield doc_id, text, merged, b"".join(kept)


def _kept(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        rows = [(d, len(t), [{"begin": a, "end": b} for a, b in m], k) for d, t, m, k in _cut(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = [(d, len(t), len(t) - len(k), len(m), hashlib.sha256(k).hexdigest()) for d, t, m, k in _cut(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole text of documents loses to repeats, and a digest of what stays."""
    return _joined(common.table(spark, sf_dir, "documents"), CROWD, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

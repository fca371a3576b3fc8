"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Words are those of the decontamination stage; five make a shingle; documents
link at a Jaccard similarity of ``THRESHOLD`` or more of their shingle sets.
Equal sets are one node; copies are never expanded.

1. A signature is ``TREES`` tries of ``DEPTH`` values.  Every set matches at full
   depth first; each set then shortens its prefixes, least crowded trie node
   first, until the target recall holds for a neighbour at the threshold
   (``wishes``): its most crowded nodes stay deep.  A neighbour helps to crowd the
   nodes that it shares, so the recall is that of the worst choice of deep trees
   (``hidden``).  A node is as shallow as its neediest set asks.
2. Sets of one node are dealt to blocks, bounded in sets and in shingles.  A block
   is one packed row, sorted into its trie; pairs inside it and pairs of blocks
   are compared by whole signatures, each pair in the first tree where it meets.
3. In nodes of several blocks, sets so near to the least set of their node that any
   two of them must link (``_cores``) are counted without being compared: with d
   shingles of the centre R lost and i new ones, w = d + t*i and w1 + w2 <=
   (1 - t)*|R| imply a similarity of t or more.  So a large group of close copies
   costs rows in proportion to its size.  A large group of loose copies, whose
   links must be counted one by one, still pairs its blocks.
4. Texts travel for what is left, and similarities are exact.

A document without words links to nothing.  Sets too small to link to any other
set at the threshold never enter the forest.  Rows may repeat, also with one
doc_id; they are copies.  Null doc_ids stay and are never a class id while the
class has another.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import components, spread_join

THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.999
#: Low bits of a trie node that name its tree.
TREE = 31
#: Sets and shingles in a block of a trie node.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Pairs compared at once, and bytes of text of cells that are verified together.
PAIRS, CELL_BYTES = 1 << 15, 1 << 20
#: Standard deviations that a signature may fall below the threshold.
SLACK = 6.0
KEY = ["k1", "k2"]


@cache
def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The depth at which even a set that shortens all its prefixes meets the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


def least_size(threshold: float) -> int:
    """Shingles that a set needs to reach the threshold with a different set: n / (n + 1) >= threshold."""
    return max(1, math.ceil(threshold / (1 - threshold) - 1e-9)) if threshold < 1 else 1 << 62


@cache
def hidden(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many trees a set may leave deep, whichever they are.

    A pair at the threshold shares the shallow node in a binomial number of
    trees.  If that is more than k, it meets in one of the others whatever k
    trees stay deep.
    """
    p = threshold ** prefix_length(threshold, recall=recall)
    miss = np.cumsum([math.comb(TREES, k) * p**k * (1 - p) ** (TREES - k) for k in range(TREES + 1)])
    return int(np.searchsorted(miss, 1 - recall, "right")) - 1


def wishes(sizes: list[tuple[int, int]], threshold: float = THRESHOLD, recall: float = RECALL) -> dict[int, int]:
    """node -> depth that one set asks for, from (sets in its shallow node, node).

    All begin at full depth; the least crowded are shortened first, until no
    more are deep than may be.  Nodes that the set has to itself are not listed.
    """
    shallow, deep = prefix_length(threshold, recall=recall), hidden(threshold, recall)
    order = [node for _, node in sorted(sizes)]
    return {node: shallow if k < len(order) - deep else DEPTH for k, node in enumerate(order)}


def _prefixes(signature: np.ndarray, length: int, rest: int = DEPTH) -> np.ndarray:
    """[set, tree, depth - length] -> 64-bit trie node, whose low bits are the tree, for all depths to ``rest``."""
    tree = np.arange(TREES, dtype=np.uint64)
    values = signature.reshape(len(signature), TREES, DEPTH).astype(np.uint64)
    h = np.broadcast_to(tree + np.uint64(1), (len(signature), TREES)).copy()
    out = np.zeros((len(signature), TREES, rest - length + 1), np.uint64)
    for k in range(rest):
        h = shingles.mix(h * np.uint64(0xD6E8FEB86659FD93) + values[:, :, k])
        if k + 1 >= length:
            out[:, :, k + 1 - length] = (h & ~np.uint64(TREE)) | tree
    return out.view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), TREES * DEPTH)


def _bytes(column: pa.Array | pa.ChunkedArray, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key of the shingle set as two longs, number of shingles, signature, text."""

    def step(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_shingles", pa.int64()), ("signature", pa.binary()), ("text", pa.string())])
        for batch in batches:
            for rows in common.slices(batch, "text", 1 << 20):
                values, counts = shingles.shingle_sets(common.utf8(rows.column("text")))
                keys = [(None, None) if k is None else np.frombuffer(k, "<i8").tolist() for k in shingles.set_keys(values, counts)]
                sig = iter(shingles.signatures(values, counts, TREES * DEPTH))
                sigs = [None if k is None else next(sig).tobytes() for k, _ in keys]
                columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns, rows.column("text")], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(source, step, "doc_id long, k1 long, k2 long, n_shingles long, signature binary, text string")


def _shallow_rows(sets: DataFrame, length: int) -> DataFrame:
    """node, k1, k2: the shallowest trie nodes of every set."""

    def step(batches):
        for batch in batches:
            if batch.num_rows:
                nodes = _prefixes(_signatures(batch.column("signature")), length, length)[:, :, 0]
                keys = [pa.array(np.asarray(batch.column(k)).repeat(TREES)) for k in KEY]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.reshape(-1)), *keys], names=["node", *KEY])

    return common.map_batches(sets.select(*KEY, "signature"), step, "node long, k1 long, k2 long")


def _asked(listed: DataFrame, length: int, threshold: float, recall: float) -> DataFrame:
    """shallow, wish, k1, k2 and the nodes of all depths from ``length`` on, for each listed node of a set."""

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            deep = _prefixes(_signatures(batch.column("signature")), length)
            of, tree, wish = [], [], []
            for k, at in enumerate(batch.column("at").to_pylist()):
                asked = wishes([(x["m"], x["node"]) for x in at], threshold, recall)
                of += [k] * len(asked)
                tree += [node & TREE for node in asked]
                wish += asked.values()
            of = np.array(of)
            picked = deep[of, np.array(tree)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * picked.shape[1]), pa.array(picked.reshape(-1)))
            keys = [batch.column(c).take(pa.array(of)) for c in (*KEY, "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(picked[:, 0]), pa.array(np.array(wish, np.int32)), *keys, lists], names=["shallow", "wish", *KEY, "n_shingles", "deep"])

    return common.map_batches(listed, step, "shallow long, wish int, k1 long, k2 long, n_shingles long, deep array<long>")


def forest(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """node, k1, k2, n_shingles: the trie nodes of every set after shortening, where a node has two sets or more."""
    length = prefix_length(threshold, recall=recall)
    rows = _shallow_rows(sets, length)
    sizes = rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    shared = rows.join(sizes, "node").groupBy(*KEY).agg(F.collect_list(F.struct("node", "m")).alias("at"))  # at most TREES
    asked = common.materialise(sets.sparkSession, _asked(shared.join(sets, KEY), length, threshold, recall))
    depth = asked.groupBy("shallow").agg(F.min("wish").alias("depth"), F.count("*").alias("w"))
    placed = spread_join(asked, depth, "shallow", KEY, "w", asked.count()).select(F.get("deep", F.col("depth") - length).alias("node"), *KEY, "n_shingles")
    return common.materialise(sets.sparkSession, placed)


def _grouped(batches, limit: int, column: str = "cell", sized: str | None = None):
    """Tables of whole cells of a sorted partition, each of ``limit`` bytes of ``sized`` (rows without it) or more."""
    held, size, cell = [], 0, None
    for batch in batches:
        cells = np.asarray(batch.column(column))
        if not len(cells):
            continue
        sizes = np.ones(len(cells), np.int64) if sized is None else np.array([len(x or ()) for x in batch.column(sized).to_pylist()])
        cut = np.flatnonzero(np.diff(cells)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)], strict=True):
            if size >= limit and cells[a] != cell:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            cell = cells[a]
            held.append(batch.slice(a, b - a))
            size += int(sizes[a:b].sum())
    if held:
        yield pa.Table.from_batches(held)


def _meetings(cell, side, tree, nodes, sig, hub, floor: float):
    """Pairs (i, j) of rows of one cell that meet first in its tree, with signatures that allow the threshold.

    Rows are sorted by cell.  A cell of one block has sides of -1; of a pair of
    blocks only pairs across count.  Two cores of one hub are counted already.
    """
    n = len(cell)
    end = np.append(np.flatnonzero(np.diff(cell)) + 1, n)
    later = np.repeat(end, np.diff(np.append(0, end))) - np.arange(n) - 1
    total = np.cumsum(later)
    row, ids = 0, np.arange(TREES)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")))
        many = later[row:stop]
        i = np.repeat(np.arange(row, stop), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        row = stop
        use = ((side[i] < 0) | (side[i] != side[j])) & ((hub[i] == 0) | (hub[i] != hub[j]))
        i, j = i[use], j[use]
        both = (nodes[i] == nodes[j]) & (nodes[i] != 0)
        own = tree[i]
        use = both[np.arange(len(i)), own] & ~(both & (ids < own[:, None])).any(axis=1)
        i, j = i[use], j[use]
        use = (sig[i] == sig[j]).sum(axis=1) >= floor * sig.shape[1]
        if use.any():
            yield i[use], j[use]


def _floor(threshold: float) -> float:
    """Least share of equal signature values that a pair at the threshold has, ``SLACK`` deviations down."""
    return max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH)))


def _node_matrix(lists) -> np.ndarray:
    """[row, tree] -> node, or 0, from a column of lists of nodes."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.asarray(lists.flatten())
    of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    out = np.zeros((len(lists), TREES), np.int64)
    out[of, flat & TREE] = flat
    return out


def _intersections(values: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j), sorted by i, of sets given one after another."""
    known, ids = np.unique(values, return_inverse=True)
    first = np.cumsum(counts) - counts
    mark = np.zeros(len(known), bool)
    out = np.zeros(len(i), np.int64)
    cut = np.append(np.flatnonzero(np.diff(i)) + 1, len(i))
    a = 0
    for b in cut.tolist():
        own = ids[first[i[a]] : first[i[a]] + counts[i[a]]]
        mark[own] = True
        while a < b:
            # some partners at a time, about a million shingles
            c = a + max(1, int(np.searchsorted(np.cumsum(counts[j[a:b]]), 1 << 20, "right")))
            many = counts[j[a:c]]
            start = np.cumsum(many) - many
            at = np.repeat(first[j[a:c]] - start, many) + np.arange(int(many.sum()))
            out[a:c] = np.add.reduceat(mark[ids[at]], start, dtype=np.int64)
            a = c
        mark[own] = False
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _sets_of(texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of many texts, a megabyte cut up at a time."""
    found, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            found.append(shingles.shingle_sets(part))
            part, size = [], 0
    if part:
        found.append(shingles.shingle_sets(part))
    return np.concatenate([v for v, _ in found]), np.concatenate([c for _, c in found])


def _verify(threshold: float):
    """Exact similarities of the candidates of each cell; one row per linked set."""
    floor = _floor(threshold)

    def step(batches):
        for rows in _grouped(batches, CELL_BYTES, sized="text"):
            cell, side, tree = (np.asarray(rows[c]) for c in ("cell", "side", "tree"))
            met = [*_meetings(cell, side, tree, _node_matrix(rows["at"]), _bytes(rows["signature"], np.uint16, TREES * DEPTH), np.asarray(rows["hub"]), floor)]
            if not met:
                continue
            i, j = (np.concatenate(x) for x in zip(*met, strict=True))
            values, counts = _sets_of([(t or "").encode() for t in rows["text"].to_pylist()])
            shared = _intersections(values, counts, i, j)
            # shared / union >= threshold, in whole numbers as far as floats go
            link = shared >= threshold * (counts[i] + counts[j] - shared) - 1e-9
            i, j = i[link], j[link]
            n = np.bincount(i, minlength=len(cell)) + np.bincount(j, minlength=len(cell))
            at = np.flatnonzero(n)
            if len(at):
                root = _roots(len(cell), i, j)[at]
                k1, k2 = (np.asarray(rows[k]) for k in KEY)
                columns = [k1[at], k2[at], k1[root], k2[root], n[at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*KEY, "r1", "r2", "n"])

    return step


_BLOCK = "node long, block int, bn int, bd int, keys binary, hubs binary, nodes binary, sigs binary"


def _packed(batches):
    """One row a block, its sets in the order of the block's trie."""
    schema = pa.schema([("node", pa.int64()), ("block", pa.int32()), ("bn", pa.int32()), ("bd", pa.int32()), *((c, pa.binary()) for c in ("keys", "hubs", "nodes", "sigs"))])
    for rows in _grouped(batches, 1 << 14):
        node, block, hub = (np.asarray(rows[c]) for c in ("node", "block", "hub"))
        keys = np.stack([np.asarray(rows[k]) for k in KEY], axis=1)
        sig, nodes = _bytes(rows["signature"], np.uint16, TREES * DEPTH), _node_matrix(rows["at"])
        tree = node & TREE
        own = sig.reshape(len(sig), TREES, DEPTH)[np.arange(len(sig)), tree]
        order = np.lexsort((*(own[:, k] for k in range(DEPTH - 1, -1, -1)), block, node))
        node, block, hub, keys, sig, nodes = (x[order] for x in (node, block, hub, keys, sig, nodes))
        cut = [0, *(np.flatnonzero((np.diff(node) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(node)]
        head = pa.array(order[cut[:-1]])
        parts = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (keys, hub, nodes, sig)]
        yield pa.RecordBatch.from_arrays([*(rows[c].take(head).combine_chunks() for c in ("node", "block", "bn", "bd")), *parts], schema=schema)


def _candidates(threshold: float):
    """(cell, tree, side, k1, k2) of the sets that have a candidate in their cell; rows are packed blocks."""
    floor = _floor(threshold)

    def step(batches):
        for rows in _grouped(batches, 1 << 20, sized="sigs"):
            keys, nodes, sig = _bytes(rows["keys"], np.int64, 2), _bytes(rows["nodes"], np.int64, TREES), _bytes(rows["sigs"], np.uint16, TREES * DEPTH)
            many = np.array([len(h) // 8 for h in rows["hubs"].to_pylist()])
            cell, side, tree = (np.repeat(np.asarray(rows[c]), many) for c in ("cell", "side", "node"))
            tree = tree & TREE
            used = np.zeros(len(cell), bool)
            for i, j in _meetings(cell, side, tree, nodes, sig, _bytes(rows["hubs"], np.int64), floor):
                used[i] = used[j] = True
            at = np.flatnonzero(used)
            columns = [cell[at], tree[at].astype(np.int32), side[at].astype(np.int32), keys[at, 0], keys[at, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "tree", "side", *KEY])

    return step


def _core_sets(threshold: float):
    """(k1, k2, hub) of the sets so near to their hub's centre that any two of them link."""

    def step(batches):
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hub", pa.int64())])
        for rows in _grouped(batches, CELL_BYTES, sized="text"):
            values, counts = _sets_of([(t or "").encode() for t in rows["text"].to_pylist()])
            cell = np.asarray(rows["cell"])
            centre = np.flatnonzero(np.append(True, np.diff(cell) != 0))  # sorted first in its cell
            of = np.repeat(centre, np.diff(np.append(centre, len(cell))))
            shared = _intersections(values, counts, of, np.arange(len(cell)))
            weight = (counts[of] - shared) + threshold * (counts - shared)
            near = 2 * weight <= (1 - threshold) * counts[of] - 1e-6
            near[centre] = False  # the centre is among its hub's sets once more
            yield rows.select([*KEY, "hub"]).filter(pa.array(near)).combine_chunks().to_batches()[0] if near.any() else pa.RecordBatch.from_pylist([], schema=schema)

    return step


def _in_cells(df: DataFrame, *order) -> DataFrame:
    """Cells dealt over all shuffle partitions: few bytes, but much work, so small ones must not be merged."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "cell").sortWithinPartitions("cell", *order)


def _texts(table: DataFrame, keys: DataFrame) -> DataFrame:
    """k1, k2, text of the sets listed; merged at every size, since the keys grow with the input."""
    return table.join(keys.select(*KEY).distinct().hint("merge"), KEY, "left_semi").groupBy(*KEY).agg(F.min("text").alias("text"))


def _blocks(n: str, shingles_: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles_) / BLOCK_SHINGLES)).cast("int")


def _own(*by: str) -> Column:
    return F.xxhash64(*by, F.lit(BLOCK))


def _cores(rows: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """k1, k2, hub, c1, c2, size: core sets of the nodes of several blocks, their hub's centre and number of cores.

    A set's hub is its most crowded node.  A hub's sets meet its centre, the
    least of them, in parts of a block's size.
    """
    spark = rows.sparkSession
    hubs = common.materialise(spark, rows.where("blocks > 1").groupBy(*KEY).agg(F.max(F.struct("m", "node")).getField("node").alias("hub"), F.max("n_shingles").alias("n_shingles")))
    centres = hubs.groupBy("hub").agg(F.min(F.struct(*KEY)).alias("c"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn("parts", _blocks("n", "s"))
    members = spread_join(hubs.select(*KEY, "hub"), centres.select("hub", "parts", "n"), "hub", KEY, "n", hubs.count()).select("hub", F.pmod(_own(*KEY), "parts").alias("part"), *KEY, F.lit(1).alias("o"))
    heads = centres.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))).alias("part"), F.col("c.k1").alias("k1"), F.col("c.k2").alias("k2"), F.lit(0).alias("o"))
    dealt = members.union(heads).join(_texts(table, hubs), KEY).select("hub", F.xxhash64("hub", "part").alias("cell"), "o", *KEY, "text")
    found = common.materialise(spark, common.map_batches(_in_cells(dealt, "o"), _core_sets(threshold), "k1 long, k2 long, hub long"))
    sizes = found.groupBy("hub").agg(F.count("*").alias("size")).where("size > 1").join(centres.select("hub", "c"), "hub")
    sizes = sizes.withColumn("w", F.col("size"))
    return spread_join(found, sizes, "hub", KEY, "w", found.count()).select(*KEY, "hub", F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), "size")


def _dealt(rows: DataFrame, cores: DataFrame, total: int) -> DataFrame:
    """k1, k2, hub and the list ``at`` of (node, block, bn, bd) of every set in a shared node.

    Blocks of a node: first bn blocks of sets to compare with all, then bd blocks
    of cores of the node's largest hub, which need no comparison among each other.
    """
    rows = rows.join(cores.select(*KEY, "hub"), KEY, "left")
    one = rows.where("blocks = 1").select("node", *KEY, "hub", F.lit(0).alias("block"), F.lit(1).alias("bn"), F.lit(0).alias("bd"))
    many = rows.where("blocks > 1")
    per = many.groupBy("node", "hub").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    best = F.max(F.when(F.col("hub").isNotNull(), F.struct("n", "s", "hub")))
    plan = per.groupBy("node").agg(best.alias("d"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    plan = plan.select("node", F.col("d.hub").alias("own_hub"), zero("d.n").alias("dn"), zero("d.s").alias("ds"), (F.col("all_n") - zero("d.n")).alias("nn"), (F.col("all_s") - zero("d.s")).alias("ns"))
    plan = plan.select("node", "own_hub", _blocks("nn", "ns").alias("bn"), _blocks("dn", "ds").alias("bd"), (F.col("nn") + F.col("dn")).alias("w"))
    core = F.coalesce(F.col("hub") == F.col("own_hub"), F.lit(False))
    block = F.when(core, F.col("bn") + F.pmod(_own(*KEY), "bd")).otherwise(F.pmod(_own(*KEY), "bn")).cast("int")
    many = spread_join(many, plan, "node", KEY, "w", total).where("bn > 0").select("node", *KEY, "hub", block.alias("block"), "bn", "bd")
    return one.union(many).groupBy(*KEY).agg(F.first("hub").alias("hub"), F.collect_list(F.struct("node", "block", "bn", "bd")).alias("at"))


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): doc_id and key of every row; key, class key and n_links of every linked set."""
    spark = docs.sparkSession
    table = common.materialise(spark, keyed(docs))
    sets = table.where(F.col("n_shingles") >= least_size(threshold)).groupBy(*KEY).agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    placed = forest(sets, threshold, recall)
    sizes = placed.groupBy("node").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s")).where("m > 1").withColumn("blocks", _blocks("m", "s"))
    sizes = sizes.withColumn("w", F.col("m"))
    rows = common.materialise(spark, spread_join(placed, sizes, "node", KEY, "w", placed.count()).select("node", *KEY, "n_shingles", "m", "blocks"))
    cores = common.materialise(spark, _cores(rows, table, threshold))
    dealt = _dealt(rows, cores, rows.count()).join(sets.select(*KEY, "signature"), KEY)
    signed = common.materialise(spark, dealt.select(*KEY, F.coalesce("hub", F.lit(0)).cast("long").alias("hub"), "at", "signature"))
    listed = signed.select(*KEY, "hub", F.col("at.node").alias("at"), "signature", F.explode("at").alias("x")).select(*KEY, "hub", "at", "signature", "x.*")
    ordered = listed.withColumn("cell", F.xxhash64("node", "block"))
    blocks = common.materialise(spark, common.map_batches(_in_cells(ordered, "node", "block"), _packed, _BLOCK))
    inside = blocks.where("block < bn").withColumns({"cell": F.xxhash64("node", "block", "block"), "side": F.lit(-1)})
    partner = F.filter(F.sequence(F.lit(0), F.col("bn") + F.col("bd") - 1), lambda b: (b != F.col("block")) & (F.least(b, F.col("block")) < F.col("bn")))
    across = blocks.where("bn + bd > 1").withColumn("b", F.explode(partner))
    across = across.withColumns({"cell": F.xxhash64("node", F.least("b", "block"), F.greatest("b", "block")), "side": (F.col("b") < F.col("block")).cast("int")}).drop("b")
    seen = "cell long, tree int, side int, k1 long, k2 long"
    cells = inside.select(across.columns).union(across)
    wanted = common.materialise(spark, common.map_batches(_in_cells(cells), _candidates(threshold), seen))
    full = wanted.join(signed.select(*KEY, "hub", F.col("at.node").alias("at"), "signature").hint("merge"), KEY).join(_texts(table, wanted), KEY)
    linked = common.map_batches(_in_cells(full), _verify(threshold), "k1 long, k2 long, r1 long, r2 long, n long")
    linked = common.materialise(spark, linked.union(cores.select(*KEY, "c1", "c2", F.col("size") - 1)))
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    counts = linked.groupBy(name("k1", "k2").alias("key")).agg(F.sum("n").alias("n_links"))
    roots = components(linked.select(name("k1", "k2").alias("a"), name("r1", "r2").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("class_key"))
    return table.select("doc_id", name("k1", "k2").alias("key")), counts.join(roots, "key")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other linked sets), n_copies (other rows of the same set)."""
    rows, linked = links(docs, threshold, recall)
    sets = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), (F.count("*") - 1).alias("n_copies"))
    sets = sets.join(linked, "key", "left").withColumn("class_key", F.coalesce("class_key", "key"))
    sets = common.materialise(docs.sparkSession, sets)
    heads = sets.groupBy("class_key").agg(F.min("least").alias("class_id"), F.count("*").alias("w"))
    sets = spread_join(sets, heads, "class_key", ["key"], "w", sets.count()).select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = rows.join(sets, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), zero("n_links"), zero("n_copies"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class stays: that with the least doc_id; of repeated rows one."""
    head, mark = common.fresh(docs, "head"), common.fresh(docs, "mark")
    heads = classes(docs, threshold).select(F.col("class_id").alias(head)).where(F.col(head).isNotNull()).distinct()
    kept = docs.join(heads, F.col("doc_id") == F.col(head), "left_semi")
    kept = kept.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).select(docs.columns)
    lone = docs.where("doc_id IS NULL")
    return kept.unionByName(lone)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document."""
    return classes(common.table(spark, sf_dir, "documents"))

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from gaugeframe.llm import op8_jaccard_join as op
from gaugeframe.llm import shingles
from gaugeframe.llm.components import components
from gaugeframe.llm.op3_decontamination import words


def sets(texts):
    out = []
    for t in texts:
        w = words((t or "").encode())
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(texts, ids, threshold=0.8):
    s = sets(texts)
    kinds = sorted({x for x in s if x}, key=repr)
    root = {k: k for k in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(kinds, 0)
    for a, b in combinations(kinds, 2):
        n = len(a & b)
        if n >= threshold * (len(a) + len(b) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    out = []
    for i, x in zip(ids, s, strict=True):
        if not x:
            out.append((i, i, 0, 0))
            continue
        own = [j for j, y in zip(ids, s, strict=True) if y and find(y) == find(x) and j is not None]
        out.append((i, min(own) if own else i, links[x], s.count(x) - 1))
    return out


def near(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [None, "", "one", "one", "a b c d e", "a b c d e f", "?!"]
    for k in range(12):
        base = " ".join(r.choice(vocab) for _ in range(r.choice([9, 60, 200])))
        out += [base, base.upper() + "."] + [near(r, base, r.randint(1, 4)) for _ in range(k % 5)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    texts = corpus(seed)
    ids = [*range(len(texts) - 1), None]
    got = sorted((tuple(r) for r in op.classes(documents(texts, ids)).collect()), key=repr)
    assert got == sorted(brute(texts, ids), key=repr)


def test_crowded_nodes_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 4)
    r = random.Random(9)
    base = " ".join(f"v{r.randrange(500)}" for _ in range(150))
    texts = [near(r, base, r.randint(1, 3)) for _ in range(30)]
    got = sorted(tuple(x) for x in op.classes(documents(texts)).collect())
    assert got == sorted(brute(texts, list(range(30))))


def test_keep_one_of_each_class(documents):
    texts = corpus(4)
    ids = [*range(len(texts) - 2), 3, 3]
    want = {c for _, c, _, _ in brute(texts, ids) if c is not None}
    kept = op.keep_one(documents(texts, ids)).collect()
    assert {r.doc_id for r in kept} == want
    assert op.keep_one(documents(["x y"] * 3, [8, 8, 8])).count() == 1
    assert op.keep_one(documents([])).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 0.9])
def test_prefixes_are_shortened_to_the_recall(threshold):
    d, k = op.prefix_length(threshold), op.hidden(threshold)
    p = threshold**d
    few = lambda n: sum(math.comb(op.TREES, i) * p**i * (1 - p) ** (op.TREES - i) for i in range(n + 1))
    assert few(k) <= 1 - op.RECALL < few(k + 1)  # one tree more left deep would miss the target
    r = random.Random(3)
    for n in range(1, op.TREES + 1):
        sizes = [(r.choice([2, 3, 50, 10_000]), t) for t in r.sample(range(op.TREES), n)]
        found = op.wishes(sizes, threshold)
        assert set(found) == {t for _, t in sizes} and set(found.values()) <= {d, op.DEPTH}
        assert [found[t] for _, t in sorted(sizes)] == [d] * max(0, n - k) + [op.DEPTH] * min(n, k)


def test_recall_of_pairs_at_the_threshold():
    """Pairs of sets at J = 0.8 among their own crowd: hardly one has no shared node."""
    r = random.Random(8)
    texts = []
    for _ in range(400):  # 90 shingles; one word of 94 changed in the middle: 85 / 95
        base = [f"v{r.randrange(5000)}" for _ in range(94)]
        texts += [" ".join(base).encode(), " ".join([*base[:30], "x", *base[31:60], "y", *base[61:]]).encode()]
    values, counts = shingles.shingle_sets(texts)
    nodes = op._prefixes(shingles.signatures(values, counts, op.TREES * op.DEPTH), op.prefix_length(), op.prefix_length())[:, :, 0]
    shared = (nodes[::2] == nodes[1::2]).sum(axis=1)
    assert (shared > op.hidden()).mean() >= 0.99


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.75, 0.9])
def test_other_thresholds(documents, threshold):
    r = random.Random(11)
    texts = [" ".join("abcdefgh"[: r.randint(5, 8)]) for _ in range(6)] + ["p q r s t", "p q r s t u", "p q r s t u v"]
    base = [f"w{r.randrange(300)}" for _ in range(80)]
    texts += [near(r, " ".join(base), k) for k in (0, 1, 1, 2, 3, 4, 6)]
    got = sorted(tuple(x) for x in op.classes(documents(texts), threshold).collect())
    assert got == sorted(brute(texts, list(range(len(texts))), threshold))


def test_close_copies_of_a_crowded_node(documents, monkeypatch):
    """Cores of a hub are counted without comparison; looser copies and strangers are compared."""
    monkeypatch.setattr(op, "BLOCK", 6)
    r = random.Random(21)
    base = " ".join(f"v{r.randrange(900)}" for _ in range(300))
    other = near(r, base, 9)
    texts = [near(r, base, r.randint(0, 2)) for _ in range(40)] + [near(r, base, r.randint(6, 12)) for _ in range(10)] + [near(r, other, 1) for _ in range(10)]
    got = sorted(tuple(x) for x in op.classes(documents(texts)).collect())
    assert got == sorted(brute(texts, list(range(60))))


def test_cores_always_link():
    r = random.Random(5)
    base = [f"v{r.randrange(900)}" for _ in range(120)]
    texts = [near(r, " ".join(base), r.randint(0, 3)).encode() for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"cell": [1] * 31, "hub": [9] * 31, "k1": [0, *range(30)], "k2": [0, *range(30)], "text": [texts[0].decode(), *(t.decode() for t in texts)]})
    core = [x for out in op._core_sets(0.8)([batch]) for x in out.column("k1").to_pylist()]
    own = sets([t.decode() for t in texts])
    assert len(core) > 3
    assert all(5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) for a, b in combinations(core, 2))


def test_shingles_of_words():
    texts = [b"A b. c d e f", b"", b"one two", b"a b c d e f", b"x" * 10]
    values, counts = shingles.shingle_sets(texts)
    assert counts.tolist() == [2, 0, 1, 2, 1]
    keys = shingles.set_keys(values, counts)
    assert keys[0] == keys[3] and keys[1] is None and len(set(keys)) == 4


def test_intersections():
    rng = np.random.default_rng(0)
    own = [np.unique(rng.integers(0, 50, 20).astype(np.uint64)) for _ in range(9)]
    i, j = (np.array(x) for x in zip(*combinations(range(9), 2), strict=True))
    got = op._intersections(np.concatenate(own), np.array([len(x) for x in own]), i, j)
    assert got.tolist() == [len(np.intersect1d(own[a], own[b])) for a, b in combinations(range(9), 2)]


def test_components(spark):
    e = [("a", "b"), ("b", "c"), ("x", "y"), ("d", "d"), *((f"n{i:03}", f"n{i + 1:03}") for i in range(40))]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a string, b string")).collect()))
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", **{f"n{i:03}": "n000" for i in range(41)}}

import hashlib
import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import op3_decontamination as op


def cut(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, window=8):
    out = []
    for t in docs:
        w = cut(t)
        hit, found = set(), set()
        for name, item in items:
            if name is None:
                continue
            v = cut(item)
            n = min(window, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(str(name))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


ITEMS = "item_id long, text string, spans string"


@pytest.mark.parametrize("seed,block", [(1, 16 << 20), (2, 40)])
def test_equals_brute_force(spark, documents, seed, block):
    r = random.Random(seed)
    words = ["a", "b", "C", "d.", "É", "e-f"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([0, 3, 8, 9, 14]))) for i in range(8)] + [(3, say(10)), (None, say(9)), (20, None), (21, "")]
    texts = [say(r.randint(0, 60)) for _ in range(30)] + [None, "", "?!", items[1][1], items[1][1]] + [f"{say(3)} {t} {say(2)}" for _, t in items if t]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = sorted(op.report(documents(texts), bench, block_bytes=block).collect(), key=lambda x: x.doc_id)
    assert [tuple(x)[1:] for x in got] == brute(texts, items)


def test_single_word_item(spark, documents):
    bench = spark.createDataFrame([(1, "Alpha", "x"), (2, "beta gamma", "x")], ITEMS)
    texts = ["alpha x beta", "beta gamma beta gamma", "none"]
    got = sorted(op.report(documents(texts), bench).collect())
    assert [tuple(x)[1:] for x in got] == brute(texts, [(1, "Alpha"), (2, "beta gamma")])


def test_no_items_and_no_documents(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert [(r.n_words, r.n_hit, r.contaminated) for r in op.report(documents(["a b"]), none).collect()] == [(2, 0, False)]
    bench = spark.createDataFrame([(1, "a b c d e f g h", "x")], ITEMS)
    assert op.report(documents([]), bench).collect() == []


def test_clean_removes_spans_and_drops(spark, documents):
    one, two = "q1 q2 q3 q4 q5 q6 q7 q8", "r1 r2 r3 r4 r5 r6 r7 r8"
    bench = spark.createDataFrame([(1, one, "x"), (2, two, "x")], ITEMS)
    filler = " ".join(f"w{i}" for i in range(30))
    docs = documents([f"{filler}, {one.upper()}! {filler}", f"{one} {filler} {filler} {two}", one, None, filler])
    got = {r.doc_id: r for r in op.clean(docs, bench).collect()}
    assert set(got) == {0, 3, 4}
    assert got[0].text == f"{filler}, ! {filler}" and got[0].n_chars == len(got[0].text)
    assert got[4].text == filler and got[0].spans == "x"
    assert op.clean(docs, bench).columns == docs.columns


def test_clean_in_blocks_with_clashing_names(spark, documents):
    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    items = [(i, say(12), "x") for i in range(10)]
    bench = spark.createDataFrame(items, ITEMS)
    texts = [f"{say(40)} {t} {say(40)}" for _, t, _ in items[:5]] + [say(60), None, f"{items[1][1]} {items[2][1]}"]
    docs = documents(texts).withColumns({c: F.lit(f"own {c}") for c in ("spans_before", "items_before", "__n_words", "__spans", "__items", "n.hit")})
    whole, cut_up = (sorted(op.clean(docs, bench, block_bytes=b).collect()) for b in (1 << 20, 30))
    assert whole == cut_up and op.clean(docs, bench).columns == docs.columns
    want = [i for i, (n, hit, n_items, _, _) in enumerate(brute(texts, [x[:2] for x in items])) if n_items < 2 and hit <= 0.5 * n]
    assert [x.doc_id for x in whole] == want and all(x.spans_before == "own spans_before" for x in whole)


def test_automaton_is_flat_and_blocks_are_streamed(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(300))) for i in range(200)]
    size = sum(len(t) for _, t in items)
    built = op.ItemAutomaton([(str(i), op.words(t.encode())) for i, t in items])
    flat = sum(x.itemsize * len(x) for x in (built.first, built.word, built.to, built.link, built.length)) + built.pairs.nbytes
    assert flat < 12 * size and len(pickle.dumps(built)) < 40 * size
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = op.blocks(bench, size // 5)
    first = next(got)  # a generator: the rest is still in the table
    rest = [*got]
    assert len(rest) >= 4 and max(sum(len(w) for _, item in b for w in item) for b in [first, *rest]) < size // 2
    assert sorted(int(n) for b in [first, *rest] for n, _ in b) == list(range(200))

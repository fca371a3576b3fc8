import re

import numpy as np

import corpus_pipeline
from gaugeframe.llm import op1_quality_rules, vocab
from tests.llm.test_op1_quality_rules import brute as statistics
from tests.llm.test_op3_decontamination import brute as decontaminated
from tests.llm.test_op3_decontamination import cut
from tests.llm.test_op7_secret_scan import masked
from tests.llm.test_op8_jaccard_join import brute as classes


def cleaned(text, items, window=8):
    """The text without the words of any window of an item, and without what stands between them."""
    at = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    w, hit = cut(text), set()
    for _, item in items:
        v = cut(item)
        n = min(window, len(v))
        known = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        hit.update(k for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in known for k in range(i, i + n))
    for k in sorted(hit, reverse=True):
        if k + 1 not in hit:
            end = at[k][1]
        if k - 1 not in hit:
            text = text[: at[k][0]] + text[end:]
    return text


def test_stages_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.common.materialise(spark, stage(spark, now, small))
        before = {r.doc_id: r for r in now.collect()}
        after = {r.doc_id: r for r in out.collect()}
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "quality rules":
            rules = op1_quality_rules.fit(docs, labels)
            counts = {i: op1_quality_rules.count_text((r.text or "").encode()) for i, r in before.items()}
            named = [dict(zip(op1_quality_rules.COUNTS, c, strict=True)) for c in counts.values()]
            shares = {k: np.array([n[a] / max(n[b], 1) for n in named]) for k, (a, b) in op1_quality_rules.FEATURES.items()}
            hit = dict(zip(counts, rules.predict(shares).tolist(), strict=True))
            stats = {i: statistics(r.text) for i, r in before.items()}
            want = {i for i, x in stats.items() if x[0] >= 50 and 100 * x[4] <= 50 * x[0] and hit[i] == 0}
            assert set(after) == want and all(after[i] == before[i] for i in want) and 0 < len(want) < len(before)
        elif name == "near duplicates":
            ids = sorted(before)
            assert set(after) == {c for _, c, _, _ in classes([before[i].text for i in ids], ids)}
        elif name == "decontamination":
            ids = sorted(before)
            found = decontaminated([before[i].text for i in ids], items)
            want = {i for i, (n, hit, n_items, _, _) in zip(ids, found, strict=True) if n_items < 2 and hit <= 0.5 * n}
            assert set(after) == want
            for i in want:
                assert after[i].text == cleaned(before[i].text, items)
        elif name == "secrets":
            assert set(after) == set(before)
            for i in after:
                assert after[i].text == masked(before[i].text)
                assert after[i].n_chars == len(after[i].text) or after[i] == before[i]
        else:
            lib = vocab.library(vocab.default_path())
            assert set(after) == set(before)
            for i, r in after.items():
                assert r.ids == lib.encode(before[i].text, add_special_tokens=False).ids
        now = out


def test_names_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secrets", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None

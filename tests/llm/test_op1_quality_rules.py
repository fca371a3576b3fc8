import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import op1_quality_rules as op


def brute(text):
    t = text or ""
    words, word = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.strip(" \t\n\x0b\x0c\r"):
            dup += x in seen
            seen.add(x)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    twice = {k for at in where.values() if len(at) > 1 for i in at for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(twice)


def test_counts_equal_brute_force(odd_texts):
    for t in odd_texts:
        assert op.count_text((t or "").encode())[:5] == brute(t)


def test_query_on_odd_documents(spark, documents, odd_texts):
    ids = [None, *range(len(odd_texts) - 1)]
    rules = op.DecisionList([[op.Test("symbols_per_word", True, 0.5)], [op.Test("repeat_share", True, 0.9), op.Test("mean_word", False, 9.0)]])
    docs = documents(odd_texts, ids)
    got = op.judge(docs, rules).collect()
    assert len(got) == len(odd_texts)
    for r in got:
        assert r.kept == (not r.base_failed and r.rule == 0)
        assert r.base_failed == (r.s_n_words < 50 or 100 * r.s_n_repeat_words > 50 * r.s_n_words)


def test_keep_leaves_every_column_as_it_was(spark, documents, odd_texts):
    rules = op.DecisionList([[op.Test("mean_word", False, 1.0)]])
    docs = documents(odd_texts).withColumns({c: F.lit(f"own {c}") for c in ("rule", "kept", "base_failed", "s_n_words", "s_text", "n.words")})
    verdict = {r.doc_id: r.kept for r in op.judge(docs, rules).collect()}
    kept = op.keep(docs, rules)
    assert kept.columns == docs.columns
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if verdict[r.doc_id])
    assert 0 < kept.count() < len(odd_texts)
    with pytest.raises(ValueError, match="already"):
        op.judge(docs, rules, ("doc_id", "rule"))
    with pytest.raises(ValueError, match="already"):
        op.statistics(docs, ("doc_id", "s_n_words"))


def test_query_equals_brute_force(spark, documents, odd_texts, tmp_path):
    t = odd_texts + ["many words " * 40 + " ".join(f"w{i}" for i in range(90))] * 2
    documents(t).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 2), 0) for i in range(len(t))] + [(None, 1, 0), (99, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(op.op1_quality_rules(spark, str(tmp_path)).collect())
    assert [r.doc_id for r in got] == list(range(len(t)))
    for r, own in zip(got, t, strict=True):
        want = brute(own)
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_learning_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = {k: rng.random(2000) for k in ("a", "b", "c")}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.2) & (x["c"] > 0.7))
    found = op.learn(x, bad)
    hit = found.predict(x) > 0
    assert 1 <= len(found.rules) <= 8
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_columns_equal_predictions(spark):
    rules = op.DecisionList([[op.Test("a", True, 0.5), op.Test("b", False, 0.5)], [op.Test("b", True, 0.75)]])
    v = [(i / 7 % 1.0, i / 5 % 1.0) for i in range(40)]
    df = spark.createDataFrame(v, "a double, b double")
    got = [r[0] for r in df.select(rules.column({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == rules.predict({"a": np.array([p[0] for p in v]), "b": np.array([p[1] for p in v])}).tolist()


def test_fit_without_labels_keeps_all(spark, documents):
    docs = documents(["word " * 60])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.fit(docs, labels).rules == []
    one = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert op.fit(docs, one).rules == []
    assert op.judge(documents([]), op.DecisionList()).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = op.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = op.judge(docs, rules).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed")
    r = held.agg(F.expr("count_if(kept AND quality = 1) AS kept"), F.expr("count_if(quality = 1) AS good"), F.expr("count_if(NOT kept AND quality = 0) AS caught"), F.expr("count_if(quality = 0) AS bad")).first()
    assert r.kept >= 0.995 * r.good and r.caught >= 0.9 * r.bad

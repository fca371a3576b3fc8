import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import op6_substring_dedup as op
from gaugeframe.llm import two_stage


@pytest.mark.parametrize("seed", range(25))
def test_two_stage_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    depth = int(rng.choice([3, 9, 16]))
    regions = [bytes(rng.integers(0, 3, int(rng.integers(depth, depth + 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
    text = np.frombuffer(b"".join(regions), np.uint8)
    size = np.array([len(r) for r in regions])
    begin = np.cumsum(size) - size
    starts = size - depth + 1
    order = two_stage.suffix_order(text, begin, starts, begin + size, depth)
    raw = text.tobytes()
    assert sorted(order.tolist()) == [int(begin[i] + j) for i in range(len(regions)) for j in range(starts[i])]
    seen = [raw[p : p + depth] for p in order.tolist()]
    assert seen == sorted(seen)
    lcp = two_stage.common_prefixes(text, order, depth)
    for k in range(1, len(seen)):
        n = next((i for i in range(depth) if seen[k][i] != seen[k - 1][i]), depth)
        assert lcp[k] == n


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = op.LENGTH
    c = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        at = [i for i in range(len(t) - n + 1) if c[t[i : i + n]] > 1]
        out.append(op.merge_spans(at, [i + n for i in at]))
    return out


def texts(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passage, line = say(450), say(230)
    edited = passage[:220] + "#" + passage[221:]
    out = [None, "", "x" * 199, "y" * 200, "z" * 700, passage, passage, "\x00" * 450]
    out += [say(60) + passage + say(r.randint(0, 300)) for _ in range(6)]
    out += [say(50) + edited + say(30), say(10) + line + say(40) + line, say(900), say(199)]
    return out


@pytest.mark.parametrize("crowd", [op.CROWD, 2, 1])
def test_equals_brute_force(spark, documents, crowd):
    t = texts(3)
    got = sorted(op.remove_repeats(documents(t), crowd).collect())
    want = brute(t)
    for x, own, spans in zip(got, t, want, strict=True):
        assert [(s.begin, s.end) for s in x.spans or ()] == spans
        raw, at, kept = (own or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        assert bytes(x.kept) == kept + raw[at:] and x.n_bytes == len(raw)


def test_repeated_rows_and_null_ids(documents):
    long_ = "".join(random.Random(1).choice("abcdef") for _ in range(500))
    got = op.remove_repeats(documents([long_, long_, "short"], [1, 1, None])).collect()
    assert sorted((r.doc_id is None, len(r.kept)) for r in got) == [(False, 0), (False, 0), (True, 5)]


def test_pieces_hold_every_window():
    rng = np.random.default_rng(3)
    t = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 199, 200, 5000)]
    for found in (op.segments(t), op.segments(t, 700)):
        for i, x in enumerate(t):
            own = found[0] == i
            assert sorted(k for s, w in zip(found[1][own], found[2][own], strict=True) for k in range(s, s + w)) == list(range(max(0, len(x) - 199)))


def test_cut_pieces_still_match(spark, documents, monkeypatch):
    t = texts(8)
    whole = op.segments
    monkeypatch.setattr(op, "segments", lambda x: whole(x, 300))
    assert [len(op.segments([(v or "").encode()])[0]) >= 0 for v in t]
    want = brute(t)
    got = sorted(op.remove_repeats(documents(t)).collect())
    assert [[(s.begin, s.end) for s in x.spans or ()] for x in got] == want


def test_empty_table(documents):
    assert op.remove_repeats(documents([])).collect() == []


def test_crowded_anchor_splits_into_small_groups(spark, documents):
    """One passage in many texts whose neighbourhoods differ: no group that is sorted is larger than the crowd."""
    r = random.Random(12)
    say = lambda n: "".join(r.choice("abcd") for _ in range(n))
    passage, tail = say(210), say(40)
    t = [say(150) + passage + (tail if i % 3 else say(9) + tail) + say(120) for i in range(60)]
    docs = documents(t)
    assert [[(s.begin, s.end) for s in x.spans or ()] for x in sorted(op.remove_repeats(docs, 4).collect())] == brute(t)
    rows = op._rows(docs)
    segs = op._segment_rows(rows).withColumn("once", F.lit(True)).withColumnRenamed("place", "p")
    listed = segs.groupBy(*op.ROW).agg(F.collect_list(F.struct("anchor", F.col("p").alias("place"), "once")).alias("wanted"))
    parts = op.common.map_batches(rows.select(*op.ROW, "text").join(listed, op.ROW), op._fetch, op._PARTS_SQL)
    assert parts.groupBy("cell").count().agg(F.max("count")).first()[0] > 4
    small, _ = op._small_groups(parts, 4)
    assert small.groupBy("cell").count().agg(F.max("count")).first()[0] <= 4


def test_query_columns_equal_brute_force(spark, documents, odd_texts, tmp_path):
    t = texts(5) + odd_texts
    documents(t).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op.op6_substring_dedup(spark, str(tmp_path)).collect()))
    want = []
    for i, (own, spans) in enumerate(zip(t, brute(t), strict=True)):
        raw, at, kept = (own or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        want.append((i, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert got == want

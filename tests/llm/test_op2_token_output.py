import struct
import zlib

import numpy as np
import pytest

from gaugeframe.llm import op2_token_output as op
from gaugeframe.llm import rans, vocab


@pytest.mark.parametrize("n", [0, 1, 8, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 40_000])
def test_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_407).astype(np.uint32)
    lengths = [n // 2, 0, n - n // 2]
    shard = rans.Shard(rans.encode(ids, lengths))
    assert (shard.decode() == ids).all()
    assert [len(x) for x in shard.documents(2)] == lengths
    if shard.n_blocks > 2:
        assert (shard.decode(1, 2) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()


def test_one_symbol_and_large_ids():
    for ids in (np.zeros(20_000, np.uint32), np.array([2**31, 5, 2**31], np.uint32)):
        assert (rans.Shard(rans.encode(ids, [len(ids)])).decode() == ids).all()


def test_damage_is_seen():
    data = bytearray(rans.encode(np.arange(1000, dtype=np.uint32), [1000]))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Shard(bytes(data))
    with pytest.raises(ValueError):
        rans.Shard(bytes(data[:10]))


def test_documents_through_files(spark, documents, odd_texts, tmp_path):
    ids = [None, 7, 7, *range(len(odd_texts) - 3)]
    out = str(tmp_path / "shards")
    op.write_shards(documents(odd_texts, ids), out, shard_ids=1000)
    got = sorted(op.read_shards(spark, out).collect(), key=lambda r: r.start)
    t = vocab.library(vocab.default_path())
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, odd_texts[i] is not None, (odd_texts[i] or "").encode()))
    at = 0
    for r, i in zip(got, order, strict=True):
        want = [*t.encode(odd_texts[i] or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (ids[i], at, len(want))
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want)
        at += len(want)


def test_query_gives_digests(spark, small):
    got = {r.doc_id: r for r in op.op2_token_output(spark, small).collect()}
    t = vocab.library(vocab.default_path())
    at = 0
    for r in sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 1]
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_empty_table(spark, documents, tmp_path):
    out = str(tmp_path / "none")
    op.write_shards(documents([]), out)
    assert op.read_shards(spark, out).collect() == []

import hashlib
import json
import random
import struct

import numpy as np
import pytest

from gaugeframe.llm import op5_bpe as op
from gaugeframe.llm import vocab

PATH = vocab.default_path()


def test_pair_check_equals_merging():
    bpe = op._chunks(PATH).bpe
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 49_406, 4000), rng.integers(0, 49_406, 4000)
    fit = np.array([not bpe.strings[t].endswith(bpe.end) for t in a])
    a, b = a[fit], b[fit]

    def own(t):
        s = bpe.strings[t]
        end = s.endswith(bpe.end)
        s = s[: -len(bpe.end)] if end else s
        ids = [bpe.ids[c] for c in s]
        return [*ids[:-1], bpe.ids[s[-1] + bpe.end]] if end else ids

    want = [bpe.merge(own(x) + own(y)) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert bpe.compatible(a, b).tolist() == want


def test_speculation_equals_merging_and_library():
    bpe, lib = op._chunks(PATH).bpe, vocab.library(PATH)
    r = random.Random(1)
    pieces = sorted({"".join(r.choice("aeilnorstthingly") for _ in range(r.randint(1, 18))) for _ in range(2000)} | {"a" * 17, "lll", "ing" * 6})
    got = bpe.encode_pieces(pieces)
    assert got == [bpe.merge(bpe.symbols(p)) for p in pieces]
    assert got == [lib.encode(p, add_special_tokens=False).ids for p in pieces]


def test_texts_equal_library(spark, documents, odd_texts):
    lib = vocab.library(PATH)
    r = random.Random(2)
    alpha = "aZé ß\tİ'sle <|endoftext|>0١—̸́=e \x1c\x85ſΣ."
    texts = odd_texts + ["".join(r.choice(alpha) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["<|startoftext|>Hi<|endoftext|>", "don't I'LL 'section"]
    got = sorted(op.round_trip(documents(texts)).collect())
    for x, t in zip(got, texts, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        text = lib.decode(ids, skip_special_tokens=False)
        assert tuple(x)[1:] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t


def test_encode_and_decode_frames(spark, documents):
    lib = vocab.library(PATH)
    texts = ["Hello there", None, "naïve — 42"]
    enc = op.encode(documents(texts, [5, None, 5]))
    assert sorted(map(tuple, enc.collect()), key=repr) == sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in zip([5, None, 5], texts, strict=True)), key=repr)
    assert sorted(r.text for r in op.decode(enc).collect()) == sorted(lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in texts)
    assert op.encode(documents([])).collect() == []


def test_cache_stays_bounded():
    c = op.Chunks(op._chunks(PATH).bpe, 10 * op._ENTRY)
    for i in range(20):
        c.learn({f"w{i}{j}".encode() for j in range(5)} | {b"always"})
        assert len(c) + len(c.old) <= 30 and len(c.parts) + len(c.parts.old) <= 30
        assert b"always" in c


def test_very_long_pieces_equal_library():
    bpe, lib = op._chunks(PATH).bpe, vocab.library(PATH)
    r = random.Random(6)
    for word in ("a" * 5000, "".join(r.choice("aeilnorst") for _ in range(200_000)), "ab" * 300):
        assert bpe.encode_pieces([word, "short"])[0] == lib.encode(word, add_special_tokens=False).ids


def test_merging_beside_others_equals_merging_alone():
    bpe = op._chunks(PATH).bpe
    r = random.Random(7)
    words = [bpe.symbols("".join(r.choice("abinegrst") for _ in range(r.randint(1, 30)))) for _ in range(500)]
    assert bpe.merge_many(words) == [bpe.merge(w) for w in words]
    assert bpe.merge_many([]) == []


def test_other_files_are_refused(tmp_path):
    spec = vocab.spec(PATH)
    spec["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not built"):
        op.SpeculativeBpe(str(other))

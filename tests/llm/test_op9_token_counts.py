import random

import pytest
from tokenizers import models

from gaugeframe.llm import op9_token_counts as op

PIECES, UNK = op.zipf_vocabulary(op.default_path())


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_library(fallback):
    lib, own = models.Unigram(PIECES, UNK, fallback), op.CountingViterbi(PIECES, UNK, fallback)
    r = random.Random(3)
    alpha = "abthingesly가힣é▁<0x>あ漢☃😀z"
    for _ in range(2000):
        t = "".join(r.choice(alpha) for _ in range(r.randint(1, 14)))
        assert own.count(t) == len(lib.tokenize(t)), t


def test_ties_prefer_the_earliest_start():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0), ("abc", -3.0)]
    lib, own = models.Unigram(pieces, 0, False), op.CountingViterbi(pieces, 0, False)
    for t in ("a", "ab", "abc", "abcabc", "bca", "xa", "xxa", "axxb"):
        assert own.count(t) == len(lib.tokenize(t)), t


def test_frame(documents, odd_texts):
    lib = models.Unigram(PIECES, UNK, True)
    got = sorted(op.token_counts(documents(odd_texts)).collect())
    for r, t in zip(got, odd_texts, strict=True):
        words = [w.decode() for w in (t or "").encode().split()]
        assert (r.n_words, r.n_tokens) == (len(words), sum(len(lib.tokenize("▁" + w)) for w in words))
    assert op.token_counts(documents([])).collect() == []


def test_cache_is_bounded():
    c = op.WordCounts(op.CountingViterbi(PIECES, UNK), 5)
    for i in range(30):
        assert c[f"word{i}".encode()] > 0
        assert len(c) <= 5

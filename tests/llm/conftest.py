import random

import pytest

#: doc_id long, text string, and columns whose names clash with those operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, items string, key string, row string, kept string, n_words string, `rule` string"


def make(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents tables with extra, clashing columns."""
    return lambda texts, ids=None: make(spark, texts, ids)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties and repeats."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Ümlaut", "naïve", "x1", "the", "of", "日本", "don't", "<|endoftext|>"]
    long_ = " ".join(r.choice(words) for _ in range(30_000))
    mid = " ".join(r.choice(words) for _ in range(120))
    return [None, "", " \n\t ", "one", mid, mid, mid + " end", long_, long_, "\x00nul\x00 byte", "a" * 5000, "\n".join(["same line here"] * 40), "é" * 400]


@pytest.fixture(scope="session")
def rows():
    """Collected rows as tuples in a comparable order."""

    def collect(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

    return collect

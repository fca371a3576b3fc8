"""Token counts by a Viterbi pass that keeps no path.

A unigram vocabulary (pieces with scores) is matched by Aho-Corasick; dynamic
programming over the end positions carries the best score and the number of
pieces of the best path, never the path.  Ties are those of the public
tokenizers' unigram model: a later candidate replaces an earlier one only with
a strictly higher score, so the earliest start (the longest piece) wins; a
character without a piece of its own costs ``min_score - 10``; runs of unknown
characters are one piece, or their bytes where all byte pieces exist.

The given files hold no unigram model, and none is trained here.  The default
vocabulary takes the pieces of the public 32k file in their order and gives
the piece of rank r the score ``-ln(r + 1)`` (Zipf's law), fixed by rule.  White
space separates words; each word is preceded by the mark U+2581.

Null and empty texts have no tokens.  Results are per row, repeated rows too;
only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Penalty of an unknown character below the lowest score, fixed value.
UNKNOWN_PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def zipf_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores by rank, and the id of the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), -math.log(i + 1)) for i in range(sp.get_piece_size())]
    return pieces, sp.unk_id()


class CountingViterbi:
    """Counts the pieces of the best segmentation of a string."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        # ids go by string: of equal strings the last counts, as in the library
        scores = {piece: score for piece, score in pieces}
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.singles = {p for p in scores if len(p) == 1}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))

    def count(self, text: str) -> int:
        """Pieces of the best path through ``text``."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        #: pieces on the best path to here, and whether its last is unknown
        pieces = [0] * (n + 1)
        tail = [False] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for end, (length, score) in self.automaton.iter(text):
                ends[end + 1].append((length, score))
        for e in range(1, n + 1):
            top, count, unknown = None, 0, False
            # longest first, that is, by rising start
            for length, score in sorted(ends[e], reverse=True):
                s = e - length
                if best[s] is not None and (top is None or score + best[s] > top):
                    top, count, unknown = score + best[s], pieces[s] + 1, False
            if text[e - 1] not in self.singles and best[e - 1] is not None:
                score = self.unknown_score + best[e - 1]
                if top is None or score > top:
                    own = len(text[e - 1].encode()) if self.bytes else 0 if tail[e - 1] else 1
                    top, count, unknown = score, pieces[e - 1] + own, True
            best[e], pieces[e], tail[e] = top, count, unknown
        return pieces[n]


class WordCounts(dict):
    """word (UTF-8) -> number of pieces; bounded."""

    def __init__(self, model: CountingViterbi, limit: int = 1_000_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self.model.count(MARK + word.decode())
        return found


_COUNTS: dict[str, WordCounts] = {}


def _counts(path: str) -> WordCounts:
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(CountingViterbi(*zipf_vocabulary(path)))
    return _COUNTS[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words (separated by ASCII white space) and n_tokens of every text."""
    path = path or default_path()

    def step(batches):
        counts = _counts(path)
        for batch in batches:
            for rows in common.slices(batch, "text"):
                words = [t.split() for t in common.utf8(rows.column("text"))]
                n = [sum(map(counts.__getitem__, w)) for w in words]
                columns = [rows.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(source, step, "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents."""
    return token_counts(common.table(spark, sf_dir, "documents"))

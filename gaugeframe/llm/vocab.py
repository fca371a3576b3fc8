"""A word-end BPE vocabulary file: reading it, and cutting text into its pieces."""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

_MARKS = rb"[!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]*"
#: Latin letters that normalisation only lower-cases, between punctuation that can
#: neither begin a contraction nor a special token: each makes pieces of its own.
SIMPLE = re.compile(rb"(" + _MARKS + rb")((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)(" + _MARKS + rb")")

#: Lower case for the letters of ``SIMPLE``: A-Z, and what follows \xc3 in the upper half.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))


def default_path() -> str:
    """Where the public word-level BPE file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's own tokenizer, without truncation and padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def spec(path: str) -> dict:
    """The file as it is; what is built from it is kept, not this."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def check(spec: dict, pieces: str) -> None:
    """Refuses a file whose normalisation or splitting is not the one that is built here."""
    normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    split = {"type": "Split", "pattern": {"Regex": pieces}, "behavior": "Removed", "invert": True}
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    plain = all(not spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    bare = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if spec.get("normalizer") != normal or before[0] != split or not level.items() <= before[-1].items() or len(before) != 2 or not plain or not bare or spec.get("decoder"):
        raise ValueError("this vocabulary file normalises or splits in a way that is not built here")


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in plain else chr(next(other)) for b in range(256))


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class LibraryChunks(dict):
    """chunk without white space -> packed ids, filled by the tokenizers library.

    Normalisation and splitting never look across white space, so the ids of a
    text are those of its chunks one after another: ``b"".join(map(self
    .__getitem__, text.split()))``.  ``trim`` keeps the memory bounded.
    """

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        self.tokenizer, self.limit = library(path), limit
        self.model = self.tokenizer.model
        self.parts: dict[bytes, bytes] = {}
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}

    def trim(self) -> None:
        for held in (self, self.parts):
            if len(held) > self.limit:
                held.clear()

    def _part(self, part: bytes) -> bytes:
        """One piece that splitting leaves whole, straight through the library's model."""
        word = part.decode("latin-1").translate(self.alphabet)
        found = self.parts[part] = pack([t.id for t in self.model.tokenize(word)])
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        m = SIMPLE.fullmatch(chunk)
        if m is None:
            ids = pack(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids)
        else:
            before, letters, after = m.groups()
            letters = letters.decode().lower().encode()
            own = self.parts
            ids = own.get(letters) or self._part(letters)
            if before:
                ids = (own.get(before) or self._part(before)) + ids
            if after:
                ids += own.get(after) or self._part(after)
        self[chunk] = ids
        return ids

"""Token ids of whole texts with a public tokenizer, one dictionary look-up per word.

The tokenizer lower-cases, drops white space and never merges across it, so the
ids of a text are those of its blank-separated pieces one after the other.
Pieces of ASCII and Latin-1 characters are split as the tokenizer's own pattern
does and its BPE model encodes each part once; all other pieces go through the
whole tokenizer.  Both caches are bounded per worker.
"""
from __future__ import annotations

import os
import re

import numpy as np

CACHE_WORDS = 500_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[!-~{LETTERS}]*")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
_encoders: dict[str, "WordEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """ids(text): little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            tokens = self.model.tokenize("".join([self.letters[b] for b in text.encode()]))
            ids = self.parts[text] = np.array([t.id for t in tokens], "<u4").tobytes()
        return ids

    def word(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.part(p) for p in PARTS.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        pieces = (text or "").replace("\n", " ").split(" ")
        words = self.words
        try:
            return b"".join([words[p] for p in pieces])
        except KeyError:
            if len(words) > CACHE_WORDS:
                words.clear()
            if len(self.parts) > CACHE_WORDS:
                self.parts.clear()
            for p in pieces:
                if p not in words:
                    words[p] = self.word(p)
            return b"".join([words[p] for p in pieces])


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

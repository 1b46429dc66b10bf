"""Tokenising whole texts with the tokenizers library, word by word.

The library's byte-pair models never merge across the words that its
pre-tokenizer makes, so each distinct word is encoded once per worker and a
text is the concatenation of its words' ids.  Words are found by a regular
expression of this module only in texts made of characters on which every
Unicode version agrees; a text with any other character, or with the string
of a special token, goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache
from itertools import islice

#: Words that a worker keeps; when full it starts anew, results are the same.
CACHE_WORDS = 400_000
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _safe() -> list[str]:
    """Characters of the plain path: stable in Unicode, lower-cased one to one, NFC as they are."""
    spans = (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))
    return [chr(c) for c in spans if len(chr(c).lower()) == 1 and unicodedata.category(chr(c)) not in ("Cf", "Cn")]


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    kind = {"L": "", "N": "", "all": ""}
    for c in _safe():
        kind["all"] += re.escape(c)
        if (k := unicodedata.category(c)[0]) in kind:
            kind[k] += re.escape(c)
    letter, number = kind["L"], kind["N"]
    odd = re.compile(f"[^{kind['all']}]|<\\|")
    byte_level = re.compile(rf"{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+")
    by_word = re.compile(rf"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^\s{letter}{number}]+")
    return odd, byte_level, by_word


def split_words(text: str, lower: bool) -> list[str] | None:
    """The pre-tokenizer's words, or None if the library itself has to split the text."""
    odd, byte_level, by_word = _patterns()
    if odd.search(text):
        return None
    return by_word.findall(text.lower()) if lower else byte_level.findall(text)


def is_word_kind(path: str) -> bool:
    """Whether the tokenizer file lower-cases and drops white space (it has a normalizer)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["normalizer"] is not None


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Words(dict):
    """Word to its packed ids; a word that isn't held is encoded by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.chars = model.tokenize, byte_chars()

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.tokenize("".join([self.chars[b] for b in word.encode()]))]
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class WordwiseEncoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = is_word_kind(path)
        self.words = Words(self.tokenizer.model)

    def encode_one(self, text: str) -> bytes:
        words = split_words(text, self.lower)
        if words is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; an empty text has none."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        return [self.encode_one(t) for t in texts]


@lru_cache(4)
def encoder(path: str) -> WordwiseEncoder:
    """One encoder per worker and tokenizer file."""
    return WordwiseEncoder(path)


def slices(rows, most: int = 256, most_chars: int = 4_000_000):
    """Lists of (key, text) rows of bounded length and total size; null texts become empty."""
    held, chars = [], 0
    for key, text in rows:
        held.append((key, text or ""))
        chars += len(text or "")
        if len(held) >= most or chars >= most_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def batch_rows(batches):
    """(first column, second column) rows of an iterator of Arrow batches, as Python values."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def take(rows, n: int):
    """Lists of up to ``n`` items."""
    rows = iter(rows)
    while got := list(islice(rows, n)):
        yield got

"""WordPiece encoding: cleaning, ideograph spacing, lower-casing, accent stripping, greedy matching."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words whose pieces one worker remembers; the table is emptied when full.
REMEMBERED_WORDS = 400_000
#: Blocks of ideographs that stand alone as words.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@lru_cache(maxsize=4)
def category_class(*prefixes: str) -> str:
    """A regular-expression class body of all characters whose Unicode category starts so."""
    ranges: list[list[int]] = []
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp)).startswith(prefixes):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class WordPiece:
    """Encodes texts under a vocabulary of whole words and ``##`` continuations."""

    def __init__(self, vocabulary: Iterable[str], unknown: str = "[UNK]", prefix: str = "##", max_chars: int = 100, lowercase: bool = True):
        self.vocabulary = frozenset(vocabulary)
        self.unknown, self.prefix, self.max_chars, self.lowercase = unknown, prefix, max_chars, lowercase
        self.longest = max(map(len, self.vocabulary), default=0)
        ascii_marks = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        marks = ascii_marks + category_class("P")
        self._control = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
        self._accent = re.compile(f"[{category_class('M')}]")
        self._lone = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in IDEOGRAPHS) + "]")
        self._words = re.compile(f"[{marks}]|[^\\s{marks}]+")
        self._ascii_words = re.compile(f"[{ascii_marks}]|[^\\s{ascii_marks}]+")
        self._seen: dict[str, list[str]] = {}

    def words(self, text: str) -> list[str]:
        if self._control.search(text):
            text = self._control.sub("", text)
        if text.isascii():
            return self._ascii_words.findall(text.lower() if self.lowercase else text)
        if self._lone.search(text):
            text = self._lone.sub(lambda m: f" {m[0]} ", text)
        if self.lowercase:
            text = self._accent.sub("", unicodedata.normalize("NFD", text.replace("Σ", "σ").lower()))
        return self._words.findall(text)

    def pieces(self, word: str) -> list[str]:
        """Longest match first; a word that cannot be cut to its end is unknown as a whole."""
        if len(word) > self.max_chars:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                piece = (self.prefix if at else "") + word[at:end]
                if piece in self.vocabulary:
                    out.append(piece)
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def encode(self, text: str | None) -> list[str]:
        out: list[str] = []
        for word in self.words(text or ""):
            got = self._seen.get(word)
            if got is None:
                if len(self._seen) >= REMEMBERED_WORDS:
                    self._seen.clear()
                got = self._seen[word] = self.pieces(word)
            out += got
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def load_tokenizer(path: str) -> WordPiece:
    """A tokenizer file in the common JSON form; only WordPiece models are accepted."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data.get("model", {})
    if model.get("type", "WordPiece") != "WordPiece" or not isinstance(model.get("vocab"), dict):
        raise ValueError("not a WordPiece tokenizer")
    normal = data.get("normalizer") or {}
    return WordPiece(model["vocab"], model.get("unk_token") or "[UNK]", model.get("continuing_subword_prefix") or "##", model.get("max_input_chars_per_word") or 100, normal.get("lowercase", True))


def wordpiece_count(spark: SparkSession, text: Column, vocabulary: Iterable[str]) -> Column:
    """Token count of a text column as an Arrow function; null counts 0."""
    handle = spark.sparkContext.broadcast(sorted(set(vocabulary)))

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = WordPiece(handle.value)
        for part in parts:
            yield part.map(encoder.count).astype("int32")

    return count(text)

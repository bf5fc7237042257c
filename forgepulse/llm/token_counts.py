"""Token counts by a map-side lookup in two tiers.

Tier 1 is a broadcast hash table from pre-token to its number of tokens. It holds every entry of
the vocabulary that is one whole pre-token: a byte-pair vocabulary lists the strings that were most
frequent when it was made, so no pass over the corpus is needed to find them, and the table is
bounded by the vocabulary. Tier 2 is a bounded cache in each Python worker, in two generations: a
pre-token that is in neither tier is encoded by the library's BPE model and remembered; when the
young generation is full it becomes the old one, and what is used again moves to the next young
one. Nothing is shuffled.

The counts are those of the library. Its pre-tokenizer is followed with the `regex` module where
both know the characters; a text with a character that the local Unicode tables leave unassigned is
counted by the library as a whole.

Cases: a null text counts as empty (0 bytes, 0 tokens); strings of special tokens inside a text
count one token each, as is the library's default; repeated rows are counted each; an empty table
gives an empty result; an input column named like a result column is replaced.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from typing import NamedTuple

import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forgepulse.llm.common import add_columns, table

CACHE_ENTRIES = 300_000
"""Pre-tokens in each of the two generations of a worker's cache."""

CACHED_CHARS = 48
"""Longer pre-tokens are encoded each time they occur, so that the cache has a bound in bytes."""


class Frequent(NamedTuple):
    definition: str
    specials: tuple[str, ...]
    lengths: dict[str, int]


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def frequent_lengths(path: str) -> Frequent:
    """Tier 1 and what the workers need for tier 2, from a tokenizers JSON file."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    content = json.loads(definition)
    pre = content.get("pre_tokenizer") or {}
    if (
        content["model"]["type"] != "BPE"
        or pre.get("type") != "ByteLevel"
        or pre.get("add_prefix_space")
        or not pre.get("use_regex", True)
        or content.get("normalizer")
        or any(t[k] for t in content["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    ):
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    bytes_of = byte_level_alphabet()
    pattern = regex.compile(public_tokenizers.PATTERN)
    pieces = []
    for entry in content["model"]["vocab"]:
        try:
            piece = bytes(bytes_of[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(piece) and pattern.findall(piece) == [piece]:
            pieces.append(piece)
    specials = tuple(t["content"] for t in content["added_tokens"])
    encoded = Tokenizer.from_str(definition).encode_batch(pieces, add_special_tokens=False)
    return Frequent(definition, specials, {p: len(e) for p, e in zip(pieces, encoded)})


class _Unassigned(Exception):
    """A pre-token holds a character of which the Unicode tables may differ."""


class PieceLengths(dict):
    """Token count by pre-token: the young generation of the cache, filled from the rest."""

    def __init__(self, frequent: Frequent) -> None:
        super().__init__()
        self.old: dict[str, int] = {}
        self.frequent = frequent
        self.tokenizer = Tokenizer.from_str(frequent.definition)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_level_alphabet().items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.specials = (
            regex.compile("|".join(map(regex.escape, frequent.specials)))
            if frequent.specials
            else None
        )
        self.unassigned = regex.compile(f"[{_unassigned_ranges()}]")

    def __missing__(self, piece: str) -> int:
        length = self.frequent.lengths.get(piece) or self.old.get(piece) or self.encoded(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = length
        return length

    def encoded(self, piece: str) -> int:
        if not piece.isascii() and self.unassigned.search(piece):
            raise _Unassigned
        return len(
            self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))
        )

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, special = [text], 0
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            special = len(parts) - 1
        try:
            return special + sum(
                sum(map(self.__getitem__, self.pattern.findall(part))) for part in parts
            )
        except _Unassigned:
            return self.whole(text)


def _unassigned_ranges() -> str:
    """A character class body of all code points without a category in the local tables."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        free = code <= sys.maxunicode and unicodedata.category(chr(code)) == "Cn"
        if free and start is None:
            start = code
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(ranges)


_counters: dict[int, PieceLengths] = {}


def _counter(shared: Broadcast) -> PieceLengths:
    """One per worker process and broadcast, kept over tasks."""
    frequent = shared.value
    key = hash(frequent.definition)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PieceLengths(frequent)
    return _counters[key]


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    limit: int = 1024,
    names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"),
) -> DataFrame:
    """`df` with the text's UTF-8 bytes, its tokens and whether they exceed `limit`."""
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def make():
        counter = _counter(shared)
        return lambda held: (len((held or "").encode("utf-8")), counter.count(held))

    n_bytes, n_tokens, over = names
    counted = add_columns(df, [text], f"`{n_bytes}` long, `{n_tokens}` long", make)
    return counted.withColumn(over, F.col(n_tokens) > F.lit(limit))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")

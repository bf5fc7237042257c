"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Ranks are read once on the driver and broadcast (their size is that of the rank file). Each worker
builds one encoder. Token ids are kept as binary, little-endian unsigned 32-bit integers, the form in
which training shards are written; `ids_array` unpacks them.

A text longer than PART_CHARS is encoded in parts. It is cut only where no match of the splitting
pattern can cross and none looks ahead: between a printable ASCII character and a white-space
character, or between an ASCII letter and an ASCII digit. The ids are those of the uncut text.

Cases: a null text counts as empty and gives no ids; null ids decode to no bytes; repeated rows are
encoded each; an empty table gives an empty result; an input column named like a result column is
replaced. Decoding returns raw bytes, as a token may end inside a character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm.common import add_columns, at_task_end, table

PART_CHARS = 1 << 16
SAFE_CUT = regex.compile(
    r"(?<=[!-~])(?=[ \n\r\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
)


class Ranks(NamedTuple):
    content: bytes
    pattern: str


def read_ranks(path: str, pattern: str = public_tokenizers.PATTERN) -> Ranks:
    with open(path, "rb") as file:
        return Ranks(file.read(), pattern)


def build_encoder(ranks: Ranks) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.content.splitlines() if line)
    return tiktoken.Encoding(
        "local",
        pat_str=ranks.pattern,
        mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        special_tokens={},
    )


_encoders: dict[int, tiktoken.Encoding] = {}
at_task_end(_encoders.clear)


def _encoder(shared: Broadcast) -> tiktoken.Encoding:
    """One per task and broadcast."""
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = build_encoder(shared.value)
    return _encoders[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of at least `size` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoder: tiktoken.Encoding, text: str | None, size: int = PART_CHARS) -> bytes:
    if not text:
        return b""
    return b"".join(
        np.array(encoder.encode_ordinary(part), dtype="<u4").tobytes() for part in parts(text, size)
    )


def decode_ids(encoder: tiktoken.Encoding, ids: bytes | None) -> bytes:
    return encoder.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()) if ids else b""


def encode(
    df: DataFrame, ranks: Ranks, text: str = "text", ids: str = "ids", count: str = "n_tokens"
) -> DataFrame:
    """`df` with the ids of the text, as binary, and their number."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        encoder = _encoder(shared)

        def coded(held: str | None) -> tuple[bytes, int]:
            packed = encode_text(encoder, held)
            return packed, len(packed) // 4

        return coded

    return add_columns(df, [text], f"`{ids}` binary, `{count}` long", make)


def decode(df: DataFrame, ranks: Ranks, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the raw bytes that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        encoder = _encoder(shared)
        return lambda held: (decode_ids(encoder, held),)

    return add_columns(df, [ids], f"`{decoded}` binary", make)


def ids_array(ids: str = "ids") -> Column:
    """Binary ids as an array of longs."""

    @F.pandas_udf("array<long>")
    def unpacked(batch: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b or b"", "<u4").astype("int64") for b in batch])

    return unpacked(ids)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_multi_50k.tiktoken, and what they decode to."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(documents, ranks).drop("text"), ranks)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

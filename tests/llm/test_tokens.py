"""Token counts and byte-level BPE against the libraries themselves."""

import os
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import awkward_texts, documents  # noqa: E402

from forgepulse.llm import byte_bpe, token_counts  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

TRICKY = [
    "a <|endoftext|> b<|endoftext|>",
    "it's they'll \n\n x  y \x1c z \t",
    "😀 👩‍👩‍👧 日本語 １２３ ՘࢏ new",
    "   trailing   ",
    "'s's'S x'd",
]


def test_counts_are_those_of_the_library(spark):
    texts = awkward_texts() + TRICKY
    got = token_counts.count_tokens(documents(spark, texts), JSON).collect()
    tokenizer = Tokenizer.from_file(JSON)
    assert len(got) == len(texts)
    for row in got:
        text = texts[row["doc_id"]] or ""
        expected = len(tokenizer.encode(text, add_special_tokens=False))
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), expected), text[:60]
        assert row["over_limit"] == (expected > 1024)


def test_cache_generations_keep_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 7)
    lengths = token_counts.PieceLengths(token_counts.frequent_lengths(JSON))
    for text in awkward_texts()[:30] * 2:
        assert lengths.count(text) == (lengths.whole(text) if text else 0)
    assert len(lengths) <= 7 and len(lengths.old) <= 7


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.frequent_lengths(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark):
    texts = awkward_texts() + TRICKY
    ranks = byte_bpe.read_ranks(RANKS)
    encoder = byte_bpe.build_encoder(ranks)
    coded = byte_bpe.decode(byte_bpe.encode(documents(spark, texts), ranks), ranks)
    rows = coded.withColumn("array", byte_bpe.ids_array()).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        expected = encoder.encode_ordinary(text)
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected == row["array"]
        assert row["n_tokens"] == len(expected)
        assert bytes(row["decoded"]) == text.encode()


@pytest.mark.parametrize("size", [1, 3, 17, 200])
def test_parts_of_a_text_give_the_ids_of_the_whole(size):
    encoder = byte_bpe.build_encoder(byte_bpe.read_ranks(RANKS))
    for text in TRICKY + awkward_texts()[3:20] + ["abc123 def  456ghi\n\n9'll x!y", "é1 1é"]:
        whole = np.array(encoder.encode_ordinary(text or ""), "<u4").tobytes()
        assert byte_bpe.encode_text(encoder, text, size) == whole
        assert "".join(byte_bpe.parts(text or "", size)) == (text or "")


def test_empty_table_and_clashing_columns(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    empty = documents(spark, [])
    assert token_counts.count_tokens(empty, JSON).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(empty, ranks), ranks).count() == 0
    df = spark.createDataFrame([("x y", 7, "q")], "text string, n_tokens long, ids string")
    assert token_counts.count_tokens(df, JSON).first()["n_tokens"] == 2
    assert byte_bpe.encode(df, ranks).first()["n_tokens"] == 2

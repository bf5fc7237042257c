"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. toxicity: documents scored 0.5 or more are rejected. The classifier learns from the labelled rows of
   `labels` and `documents`. Null and empty texts are kept.
2. near_duplicates: of each group linked by 5-word shingles at 80 percent the document with the
   smallest id stays; of rows that share that id, the first by source, lang and text. Documents
   without words are in no group and stay; of a group of null ids one row stays.
3. substring_dedup: words in windows of 50 words that also start earlier are removed. A text without
   such words stays as it is; in others the kept words are joined by one space, and n_chars is
   counted anew. A document of which nothing is left stays with an empty text.
4. mixing: documents are repeated by Poisson draws so that sources meet their target weights, then
   shuffled globally. Copies are repeated rows.
5. byte_bpe: token ids of each text, and whether they decode to its bytes.

Null text and empty tables pass through every stage; further columns keep their values, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm import byte_bpe, jaccard_join, mixing, substring_dedup, toxicity
from forgepulse.llm.common import stored, table

REPEAT_WORDS = 50
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with inner names for columns beyond those of documents, and what names them back.

    The operators replace columns named like their results, which such a column may be.
    """
    inner = {c: f"__extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    names = [(inner.get(c, c), c) for c in docs.columns]
    return docs.withColumnsRenamed(inner), lambda done: done.select(
        *[F.col(own).alias(c) for own, c in names]
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_labelled(spark, sf_dir)
    scored = toxicity.score(docs, model, name="__score", flag="__toxic")
    return scored.where(F.col("__toxic") == 0).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, named_back = _aside(docs)
    return named_back(jaccard_join.one_of_each(docs, ties=["source", "lang"]))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, named_back = _aside(docs)
    done = substring_dedup.remove_repeats(docs, REPEAT_WORDS)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    cleaned = done.withColumns(
        {
            "text": text,
            "n_chars": F.when(cut, F.char_length("kept_text").cast("long")).otherwise(
                F.col("n_chars")
            ),
        }
    )
    return named_back(cleaned)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, named_back = _aside(docs)
    return named_back(mixing.mix(docs, mixing.WEIGHTS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks), ranks)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "n_tokens", "ids", exact.alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None
"""SQL can't express the classifier and the tokenizer; tests hold every stage against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs

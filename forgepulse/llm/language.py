"""Language identification by bit-sliced Bloom filters of character n-grams.

For each language the n-grams that make up at least MIN_SHARE of its text are put into a filter. All
filters share one table of slots; a slot holds one bit per language, so a look-up of an n-gram reads
HASHES slots, and the AND of their bit masks has a 1 for every language that contains the n-gram. The
bits of all n-grams of a text are summed by language. A filter of which a share f of the slots is
set reports an absent n-gram with probability f**HASHES, so a hit rate h becomes
(h - f**HASHES) / (1 - f**HASHES), and the largest corrected rate decides.

A language has at most len(GRAMS) / MIN_SHARE n-grams in its filter by the meaning of the share, so
the table has a fixed size for each language: SLOTS bits, broadcast once. The n-grams are counted on a
bounded sample: about MAX_PER_LANGUAGE labelled texts of each language, picked by a hash of the whole row.

Cases: `und` with score 0 for a null text or one without a letter; a text none of whose n-grams is
known gets the language with most labelled rows, score 0; equal rates go to the language first by
name; rows with a null language or text are not learned from; without any learned row every
prediction is `und`; repeated rows count as often as they occur; an empty table gives an empty
result; an input column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm.common import add_columns, crc_fold, mix64, row_position, table

GRAMS = (2, 3, 4)
MIN_SHARE = 5e-5
SLOTS = 1 << 20
HASHES = 2
MAX_PER_LANGUAGE = 1500
"""Expected number of labelled texts of each language that are counted at most."""

MAX_LANGUAGES = 1024
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
NO_LETTERS = regex.compile(r"\P{L}+")


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray
    """SLOTS rows of one byte per eight languages."""
    false_rate: np.ndarray
    commonest: int


def gram_hashes(text: str, sizes: tuple[int, ...] = GRAMS) -> list[np.ndarray]:
    """64-bit hashes of the n-grams of the lower-case letters, runs of others as one space."""
    clean = f" {NO_LETTERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(clean.encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = []
    for n in sizes:
        if len(codes) < n:
            continue
        value = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
        found.append(mix64(value))
    return found


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    """The HASHES slots of each n-gram, by double hashing."""
    first, second = hashes & np.uint64(SLOTS - 1), (hashes >> np.uint64(32)) | np.uint64(1)
    return [(first + np.uint64(i) * second) & np.uint64(SLOTS - 1) for i in range(HASHES)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, size, n-gram, count), counted within each batch."""
    schema = pa.schema(
        [("language", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())]
    )
    for batch in batches:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if LETTER.search(text):
                for size, hashes in zip(GRAMS, gram_hashes(text)):
                    held.setdefault((language, size), []).append(hashes)
        for (language, size), arrays in held.items():
            grams, counts = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language] * len(grams), pa.string()),
                    pa.array(np.full(len(grams), size), pa.int32()),
                    pa.array(grams.view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                ],
                schema=schema,
            )


def fit(
    rows: DataFrame, label: str = "lang", text: str = "text", per_language: int = MAX_PER_LANGUAGE
) -> Filters | None:
    """Filters of all languages of the labelled rows; None if there are none."""
    known = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("language"),
        F.col(text).alias("text"),
        row_position(rows, "language").alias("position"),
    )
    counts = known.groupBy("language").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    counts = {r["language"]: r["count"] for r in counts}
    languages = sorted(counts)
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / counts[k])])
    drawn = F.col("position") < shares[F.col("language")]
    sample = known.where(drawn).select("language", "text")
    grams = (
        sample.mapInArrow(_count_grams, "language string, size int, gram long, n long")
        .groupBy("language", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = grams.groupBy("language", "size").agg(F.sum("n").alias("total"))
    # At most len(GRAMS) / MIN_SHARE rows for each language, by the meaning of the share.
    kept = (
        grams.join(F.broadcast(totals), ["language", "size"])  # len(GRAMS) rows a language
        .where(F.col("n") >= MIN_SHARE * F.col("total"))
        .select("language", "gram")
        .toPandas()
    )
    bits = np.zeros((SLOTS, -(-len(languages) // 8)), dtype=np.uint8)
    for i, language in enumerate(languages):
        hashes = kept.loc[kept["language"] == language, "gram"].to_numpy(np.int64).view(np.uint64)
        for slots in slots_of(hashes):
            bits[slots, i // 8] |= np.uint8(128 >> i % 8)
    fill = np.array([(bits[:, i // 8] & (128 >> i % 8) != 0).mean() for i in range(len(languages))])
    commonest = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i))
    return Filters(languages, bits, fill**HASHES, commonest)


def predict_text(filters: Filters | None, text: str | None) -> tuple[str, float]:
    if filters is None or not text or not LETTER.search(text):
        return UNKNOWN, 0.0
    hashes = np.concatenate(gram_hashes(text))
    masks = filters.slots[slots_of(hashes)[0]]
    for slots in slots_of(hashes)[1:]:
        masks = masks & filters.slots[slots]
    popcounts = np.unpackbits(masks, axis=1).sum(axis=0, dtype=np.int64)[: len(filters.languages)]
    rates = (popcounts / len(hashes) - filters.false_rate) / (1 - filters.false_rate)
    rates = np.clip(rates, 0.0, 1.0)
    if rates.sum() == 0:
        return filters.languages[filters.commonest], 0.0
    best = int(np.argmax(rates))
    return filters.languages[best], float(rates[best] / rates.sum())


def predict(
    df: DataFrame,
    filters: Filters | None,
    text: str = "text",
    name: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """`df` with the language of the text and its share of all languages' corrected rates."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def make():
        held = shared.value
        return lambda own: predict_text(held, own)

    return add_columns(df, [text], f"`{name}` string, `{score}` double", make)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    filters = fit(documents.where(~held_out))
    return predict(documents.select("doc_id", "text", held_out.alias("held_out")), filters).select(
        "doc_id", "held_out", "lang_pred", "score"
    )

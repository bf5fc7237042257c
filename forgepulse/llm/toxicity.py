"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in its lower-case form. Each
feature is scaled by r = log(share of it among toxic rows / share among others), with add-one
smoothing, where r is clear of chance, and a logistic regression is fitted on the scaled features. The fit uses a bounded sample of
labelled rows: about MAX_PER_LABEL rows of each label, picked by a hash of the label's whole row; the intercept is corrected to the
true shares of the labels. Every text is then scored as a whole by one broadcast table of 2**BITS
weights.

Cases: a null text counts as empty; an empty text gets the score of a text without features;
labels that are null or other than 0 and 1 are not learned from, nor are rows with a null text; with
rows of one label only, every score is that label, and without any it is 0; repeated rows count
as often as they occur; an empty table gives an empty result; an input column named like a result
column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm.common import (
    add_columns,
    crc_fold,
    lean,
    mix64,
    row_position,
    shuffles_removed,
    stored,
    table,
)

BITS = 18
GRAMS = (5, 6)
MAX_PER_LABEL = 3000
"""Expected number of labelled rows of each label that the fit uses at most."""

MIN_ROWS = 3
"""Features of fewer sampled rows are left out."""

ERRORS = 4.0
"""Log-count ratios within so many standard errors of 0 count as 0."""

FIT_PARTS = 12
FEATURE_ROWS = 256


class Model(NamedTuple):
    weights: np.ndarray
    """Of each hashed n-gram: its coefficient times its log-count ratio."""
    intercept: float


class Features:
    """The sorted hashed n-grams of texts; keeps one scratch table of 2**BITS flags."""

    def __init__(self, bits: int = BITS, grams: Sequence[int] = GRAMS) -> None:
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.shift = np.uint64(64 - bits)
        self.grams = grams

    def of(self, text: str | None) -> np.ndarray:
        padded = f" {(text or '').lower()} ".encode("utf-32-le", "replace")
        codes = np.frombuffer(padded, np.uint32).astype(np.uint64)
        for n in self.grams:
            if len(codes) < n + 1:  # the padding alone is no feature
                continue
            value = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                value = value * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
            self.seen[mix64(value) >> self.shift] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.int32()), ("grams", pa.binary())])
    features = Features()
    for batch in batches:
        for lo in range(0, batch.num_rows, FEATURE_ROWS):
            part = batch.slice(lo, FEATURE_ROWS)
            grams = [features.of(t.as_py()).astype(np.int32).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int32()), pa.array(grams, pa.binary())], schema=schema
            )


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: in how many of its rows of label 0 and 1 each feature occurs."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for label, grams in zip(*batch.columns):
            counts[label.as_py(), np.frombuffer(grams.as_buffer(), np.int32)] += 1
    yield pa.RecordBatch.from_pydict({"counts": pa.array([counts.tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of the counts of all tasks, of which there are FIT_PARTS at most."""
    total = np.zeros(2 << BITS, dtype=np.int64)
    for batch in batches:
        for counts in batch.column(0):
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})


def fit(
    rows: DataFrame, label: str = "toxic", text: str = "text", per_label: int = MAX_PER_LABEL
) -> Model:
    """A model of the labelled rows, from a sample of about `per_label` rows of each label."""
    known = rows.where(F.col(label).isin(0, 1) & F.col(text).isNotNull())
    shares = _shares(known, label)
    position = row_position(known, "toxicity")
    return fit_sample(
        known.where(position < _rate(shares, label, per_label)), shares, label, text, per_label
    )


def _shares(known: DataFrame, label: str) -> dict[int, int]:
    return {r[0]: r[1] for r in known.groupBy(F.col(label).cast("int")).count().collect()}


def _rate(shares: dict[int, int], label: str, per_label: int) -> Column:
    """The share of a label's rows that the sample takes."""
    one, other = (per_label / max(shares.get(k, 0), 1) for k in (1, 0))
    return F.when(F.col(label) == 1, one).otherwise(other)


def fit_sample(
    sample: DataFrame, shares: dict[int, int], label: str, text: str, per_label: int = MAX_PER_LABEL
) -> Model:
    """A model of sampled rows, where `shares` has the rows of each label before sampling."""
    flat = np.zeros(1 << BITS, dtype=np.float32)
    if len(shares) < 2:
        return Model(flat, np.inf if 1 in shares else -np.inf)
    texts = sample.select(F.col(label).cast("int"), F.col(text))
    grams = stored(
        texts.mapInArrow(lean(_features), "label int, grams binary").repartition(FIT_PARTS),
        "toxicity-sample",
    )
    # One row per task of the bounded sample, added up before one row of fixed size comes to the driver.
    parts = grams.coalesce(FIT_PARTS).mapInArrow(lean(_gram_counts), "counts binary")
    summed = parts.repartition(1).mapInArrow(lean(_summed), "counts binary")
    with shuffles_removed(grams.sparkSession):
        counts = np.frombuffer(summed.first()["counts"], np.int64).reshape(2, -1)
    used = counts.sum(axis=0) >= MIN_ROWS
    if not used.any():
        return Model(flat, float(np.log(shares[1] / shares[0])))
    smooth = (counts + 1) * used
    ratio = np.zeros(1 << BITS)
    ratio[used] = np.log(
        (smooth[1, used] / smooth[1].sum()) / (smooth[0, used] / smooth[0].sum())
    )
    error = np.sqrt((1 / smooth[:, used]).sum(axis=0))
    ratio[used] *= np.abs(ratio[used]) >= ERRORS * error
    chosen = np.flatnonzero(ratio)
    if not len(chosen):
        return Model(flat, float(np.log(shares[1] / shares[0])))
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = grams.sparkSession.sparkContext.broadcast((place, ratio[chosen]))

    @F.udf(VectorUDT())
    def scaled(held: bytes) -> SparseVector:
        places, ratios = shared.value
        own = places[np.frombuffer(held, np.int32)]
        own = np.sort(own[own >= 0])
        return SparseVector(len(ratios), own, ratios[own])

    vectors = grams.select(F.col("label").cast("double"), scaled("grams").alias("features"))
    fitted = LogisticRegression(
        maxIter=100, regParam=1e-4, standardization=False, tol=1e-5
    ).fit(vectors)
    shared.unpersist()
    sampled = [min(float(shares[k]), float(per_label)) for k in (0, 1)]
    prior = np.log(shares[1] / shares[0]) - np.log(sampled[1] / sampled[0])
    flat[chosen] = fitted.coefficients.toArray() * ratio[chosen]
    return Model(flat, float(fitted.intercept + prior))


def score(
    df: DataFrame, model: Model, text: str = "text", name: str = "score", flag: str = "predicted"
) -> DataFrame:
    """`df` with the probability that the text is toxic, and whether it is 0.5 or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        held, features = shared.value, Features()

        def probability(own: str | None) -> tuple[float, int]:
            total = float(held.weights[features.of(own)].sum(dtype=np.float64)) + held.intercept
            chance = 0.5 * (1.0 + math.tanh(0.5 * total))
            return chance, int(chance >= 0.5)

        return probability

    return add_columns(df, [text], f"`{name}` double, `{flag}` int", make)


def fit_labelled(spark: SparkSession, sf_dir: str, per_label: int = MAX_PER_LABEL) -> Model:
    """A model of the labelled rows outside the held-out fold.

    The sample is picked among the labels; texts are joined to the few picked ids only.
    """
    learned = crc_fold(F.col("doc_id"), 5) != 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = labels.where(learned & F.col("toxic").isin(0, 1))
    texts = table(spark, sf_dir, "documents").where(learned & F.col("text").isNotNull())
    with shuffles_removed(spark):
        shares = _shares(labels.join(texts.select("doc_id"), "doc_id"), "toxic")
    picked = row_position(labels, "toxicity") < _rate(shares, "toxic", per_label)
    chosen = stored(labels.where(picked), "toxicity-chosen")
    # About 2 * per_label rows, unless label rows are repeated; only then texts are shuffled.
    few = chosen.count() <= 8 * per_label
    sample = texts.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id")
    return fit_sample(sample, shares, "toxic", "text", per_label)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(documents, fit_labelled(spark, sf_dir)).select(
        "doc_id",
        (F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))).alias("held_out"),
        "score",
        "predicted",
    )

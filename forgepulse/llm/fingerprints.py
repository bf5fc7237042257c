"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a vector of LANES draws from the Cauchy distribution, in whole units of
1 / UNIT. A fingerprint is the number of paragraphs and the lane-wise sum of their vectors, both
modulo 2**64. Hence

- the order of paragraphs does not matter, and equal multisets have equal fingerprints;
- a paragraph is inserted or deleted by adding or subtracting its vector (`combine`, `without`);
- fingerprints of parts add up to that of the whole;
- a sum of Cauchy draws, each times a count, is a Cauchy draw times the sum of the absolute counts. So
  the scale of the lanes of the difference of two fingerprints is the size of the multisets' symmetric
  difference, however often a paragraph occurs. It is estimated by maximum likelihood (standard
  error about 12 percent with 128 lanes), and with the numbers of paragraphs it gives the likeness:
  the sum of the smaller counts over the sum of the larger ones.

Draws have 32 bits and lie within +-2**32, lanes wrap beyond 2**55: not in texts that fit in memory.
Two different multisets have equal fingerprints only where two paragraphs have equal 128-bit hashes
or all lanes cancel out. Draws use nothing but rounded tables and the basic operations that IEEE 754 fixes, so
all machines make the same ones.

A paragraph ends at line breaks, and within a line after '.', '!' or '?' followed by white space, so
that texts of a single line have parts as well. White space around a paragraph does not count, and
empty paragraphs are none.

Cases: a null text counts as empty, an empty text is the empty multiset (likeness of two empty ones:
1); texts of any length are hashed whole; repeated rows are hashed each; an empty table gives an
empty result; an input column named like a result column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm.common import (
    LONG_MAX,
    add_columns,
    bucket_of,
    mix64,
    range_edges,
    shuffle_parts,
    table,
)

LANES = 128
UNIT = 256
SLICE = 512
"""Paragraphs whose vectors are in memory at a time."""
PARAGRAPH_END = regex.compile(r"[\n\r]+|(?<=[.!?])\s+")

_STEPS = np.arange(LANES // 2, dtype=np.uint64)
# tan of the high and of the low 16 bits of an angle; rounded, so that no library's last bit counts.
_HIGH, _LOW = (
    np.array([math.tan(math.pi * a) for a in angles], dtype=np.float32).astype(np.float64)
    for angles in (
        [k / 2**16 - 0.5 for k in range(2**16)],
        [(k + 0.5) / 2**32 for k in range(2**16)],
    )
)


def paragraphs(text: str | None) -> list[str]:
    return [p for p in map(str.strip, PARAGRAPH_END.split(text or "")) if p]


def _draws(found: list[str]) -> np.ndarray:
    """A row of LANES Cauchy draws for each paragraph, in whole units."""
    digests = b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "replace")) for p in found)
    start, step = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    bits = mix64(start[:, None] + (step | np.uint64(1))[:, None] * _STEPS)
    halves = bits.astype("<u8", copy=False).view("<u2").reshape(len(found), LANES, 2)
    low, high = _LOW[halves[:, :, 0]], _HIGH[halves[:, :, 1]]
    return np.rint((high + low) / (1 - high * low) * UNIT).astype(np.int64)


def fingerprint(text: str | None) -> bytes:
    """8 bytes for the number of paragraphs, 8 for each lane, little-endian."""
    found = paragraphs(text)
    lanes = np.zeros(LANES, np.int64)
    for i in range(0, len(found), SLICE):
        lanes += _draws(found[i : i + SLICE]).sum(axis=0)
    return np.uint64(len(found)).tobytes() + lanes.tobytes()


def _open(mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(mark[:8], np.uint64), np.frombuffer(mark[8:], np.uint64)


def combine(a: bytes, b: bytes) -> bytes:
    """The fingerprint of both multisets together."""
    (n, x), (m, y) = _open(a), _open(b)
    return (n + m).tobytes() + (x + y).tobytes()


def without(a: bytes, b: bytes) -> bytes:
    """The fingerprint of `a` after deletion of the paragraphs of `b`."""
    (n, x), (m, y) = _open(a), _open(b)
    return (n - m).tobytes() + (x - y).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated common share of two multisets, 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (n, x), (m, y) = _open(a), _open(b)
    total, least = float(n[0]) + float(m[0]), abs(float(n[0]) - float(m[0]))
    apart = min(total, max(least, _scale((x - y).astype(np.int64) / UNIT)))
    return (total - apart) / (total + apart)


def _scale(draws: np.ndarray) -> float:
    """Maximum likelihood estimate of the scale of Cauchy draws, by Fisher scoring from the median."""
    squares = draws**2
    scale = max(float(np.median(squares)), 1 / UNIT**2)  # the scale's square
    for _ in range(10):
        scale *= math.exp(8 * (0.5 - float(np.mean(scale / (scale + squares)))))
    return math.sqrt(scale)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of the text, as binary."""

    return add_columns(df, [text], f"`{name}` binary", lambda: lambda t: (fingerprint(t),))


def with_likeness(df: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """`df` with the likeness of two fingerprint columns; null if either is null."""

    def near(x: bytes | None, y: bytes | None) -> tuple[float | None]:
        return (None if x is None or y is None else likeness(x, y),)

    return add_columns(df, [a, b], f"`{name}` double", lambda: near)


NEIGHBOUR_SCHEMA = (
    "doc_id long, n_chars long, edited string, own_mark binary, edited_mark binary, "
    "next_mark binary, near_edited double, near_next double"
)
BATCH_CHARS = 1 << 22


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Columns: doc_id, n_chars, edited (the text whose last half is replaced by the beginning of the
    next document's), own_mark, edited_mark, next_mark, near_edited, near_next. The next document is
    that in descending order of the key; the last one is followed by the first; null ids come
    last, equal ids are ordered by text. A document alone is its own next one.

    Texts are shuffled once: into ranges of the key, sorted, and read as a stream in which each row
    waits for the one after it. The first row of a range is also sent to the range before it. Only
    the cut points and one key per range come to the driver.
    """
    low = -LONG_MAX - 1
    rows = df.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("at"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    keys = df.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("at"))
    edges = range_edges(keys, "at", keys.count())
    keys = keys.withColumn("bucket", bucket_of(F.col("at"), edges))
    # The first row of each range; of rows with that key the one with the least text comes first.
    tops = sorted(keys.groupBy("bucket").agg(F.max("at").alias("top")).collect(), reverse=True)
    rows = rows.withColumn("bucket", bucket_of(F.col("at"), edges))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    if tops:
        before = {r["bucket"]: tops[i - 1]["bucket"] for i, r in enumerate(tops)}
        first = {r["bucket"]: r["top"] for r in tops}
        sends = F.create_map(*[F.lit(x) for b in first for x in (b, before[b])])
        top = F.create_map(*[F.lit(x) for b in first for x in (b, first[b])])
        ghost = F.struct(sends[F.col("bucket")].alias("bucket"), F.lit(1).alias("ghost"))
        copies = F.when(
            F.col("at") == top[F.col("bucket")], F.array(own, ghost)
        ).otherwise(F.array(own))
    else:
        copies = F.array(own)
    parts = shuffle_parts(df.sparkSession)
    dealt = (
        rows.withColumn("copy", F.explode(copies))
        .select("id", "at", "text", "copy.bucket", "copy.ghost")
        .repartition(parts, "bucket")
        .sortWithinPartitions(
            F.col("bucket"), F.col("ghost"), F.col("at").desc(), F.col("text")
        )
    )
    return dealt.mapInArrow(_pair_with_next, NEIGHBOUR_SCHEMA)


def _pair_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 2 + [pa.string()] + [pa.binary()] * 3 + [pa.float64()] * 2
    names = [column.split()[0] for column in NEIGHBOUR_SCHEMA.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
        )

    def compared(id_: int | None, own: str, mark: bytes, next_text: str, after: bytes) -> tuple:
        half = len(own) // 2
        edited = own[: len(own) - half] + next_text[:half]
        changed = fingerprint(edited)
        near = (likeness(mark, changed), likeness(mark, after))
        return (id_, len(own), edited, mark, changed, after, *near)

    waiting = None  # (id, text, mark, bucket) of the row whose next one has not come yet
    for batch in batches:
        out, held = [], 0
        for i in range(batch.num_rows):  # one text at a time
            id_, text, bucket, ghost = (
                batch.column(n)[i].as_py() for n in ("id", "text", "bucket", "ghost")
            )
            mark = fingerprint(text)
            if waiting is not None and waiting[3] == bucket:
                out.append(compared(*waiting[:3], text, mark))
                held += len(waiting[1])
            # Of several ghosts (equal keys) only the first is a next row; ghosts have none.
            waiting = None if ghost else (id_, text, mark, bucket)
            if held > BATCH_CHARS:
                yield made(out)
                out, held = [], 0
        if out:
            yield made(out)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how near others are to it."""
    return compare_with_next(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("own_mark")).alias("fingerprint"),
        F.lower(F.hex("edited_mark")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )

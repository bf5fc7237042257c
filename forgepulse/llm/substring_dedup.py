"""Substring dedup by seed and extend: winnowed anchors, extension both ways, maximal repeats.

A window is `length` consecutive words. Every word that lies in a window whose words also start at an
earlier place (smaller id, or same document and earlier start) is to be removed.

Seeds. Each window chooses its anchor: of its runs of `anchor` words the one with the least hash,
the leftmost on a tie. Equal windows choose equal anchors, and neighbouring windows mostly share theirs, so
only about 2 / (length - anchor + 2) of the positions are anchors. An anchor's stretch is the union of
the windows that chose it: the anchor extended both ways as far as it seeds windows.

Join on anchors. Stretches with the same anchor and the same words agree in all their windows, so
all but the earliest are repeats as a whole. Where stretches around one anchor differ, the earliest of
each kind is extended again, window by window: its windows are matched by their own hashes. Touching
repeats in a document are put together into maximal ones, none shorter than `length`.

Scale. Each task keeps only the earliest of equal stretches (or windows) of a chunk of documents and marks
the others at once, before the shuffle; so a passage that a third of all documents share sends one
row per chunk and no pairs are formed. What is shuffled grows with the words: one narrow row per anchor,
and the texts once to meet their repeats. A document's repeats are bounded by its own length.
Identity of ranges rests on 128 bits of hash.

Cases: a null or short text has no window and keeps its words; null ids come after all others; rows
of equal id and equal text are one place, so they do not remove each other's words, and are treated
alike; rows of equal id and different texts are ordered by a hash of the text; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgepulse.llm.common import (
    LONG_MAX,
    RangeHashes,
    WordHashes,
    add_columns,
    lean,
    mix64,
    stored,
    table,
    words_of,
)

LENGTH = 20
CHUNK_BYTES = 4 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

FOUND = "route long, kind long, id long, tie int, lo long, n long"
"""A stretch of `n` windows from window `lo` on of one document. With a kind: the earliest of its
chunk, to be compared with others of equal route and kind. Without: a repeat."""

FOUND_ARROW = pa.schema(
    [(c, pa.int32() if c == "tie" else pa.int64()) for c in ("route", "kind", "id", "tie", "lo", "n")]
)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (leftmost on a tie) in each run of `width` values."""
    least, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = least[: len(least) - step], least[step:]
        take_right = right < left
        at = np.where(take_right, at[step:], at[: len(at) - step])
        least = np.where(take_right, right, left)
        size += step
    return at


class Chunk:
    """The words of several documents in one array, ordered by id and tie, repeated rows once."""

    def __init__(self, rows: list[tuple], hashes: WordHashes, length: int) -> None:
        held: dict[tuple[int, int], tuple] = {}
        for row in rows:
            held.setdefault((row[0], row[1]), row)
        self.rows = [held[key] for key in sorted(held)]
        arrays = [hashes.of(words_of(row[2])) for row in self.rows]
        kept = [i for i, a in enumerate(arrays) if len(a) >= length]
        self.rows = [self.rows[i] for i in kept]
        arrays = [arrays[i] for i in kept]
        sizes = np.array([len(a) for a in arrays], dtype=np.int64)
        self.words = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        self.starts = np.cumsum(sizes) - sizes
        self.windows = sizes - length + 1
        self.ids = np.array([row[0] for row in self.rows], dtype=np.int64)
        self.ties = np.array([row[1] for row in self.rows], dtype=np.int32)

    def all_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and position (in the array) of every window."""
        docs = np.repeat(np.arange(len(self.rows)), self.windows)
        before = np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        return docs, np.arange(len(docs)) - before + self.starts[docs]

    def found(
        self, route: np.ndarray, kind: np.ndarray, docs: np.ndarray, lo: np.ndarray, n: np.ndarray
    ) -> pa.RecordBatch:
        """The earliest of equal stretches as they are, the others as repeats, put together.

        Stretches come in the order of document and position.
        """
        order = np.lexsort((kind, route))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (route[order[1:]] == route[order[:-1]]) & (kind[order[1:]] == kind[order[:-1]])
        repeat = np.zeros(len(order), dtype=bool)
        repeat[order[same]] = True
        first, again = np.flatnonzero(~repeat), np.flatnonzero(repeat)
        if len(again):
            r_docs, r_lo, r_end = docs[again], lo[again], lo[again] + n[again]
            opens = np.ones(len(again), dtype=bool)
            opens[1:] = (r_docs[1:] != r_docs[:-1]) | (r_lo[1:] != r_end[:-1])
            heads = np.flatnonzero(opens)
            tails = np.append(heads[1:], len(again)) - 1
            r_docs, r_lo, r_n = r_docs[heads], r_lo[heads], r_end[tails] - r_lo[heads]
        else:
            r_docs = r_lo = r_n = np.empty(0, np.int64)
        every = np.concatenate([docs[first], r_docs])
        spread = mix64(self.ids[r_docs].astype(np.uint64) ^ mix64(self.ties[r_docs].astype(np.uint64)))
        columns = [
            pa.array(np.concatenate([route[first], spread]).view(np.int64)),
            pa.concat_arrays([pa.array(kind[first].view(np.int64)), pa.nulls(len(r_docs), pa.int64())]),
            pa.array(self.ids[every]),
            pa.array(self.ties[every]),
            pa.array(np.concatenate([lo[first], r_lo]) - self.starts[every]),
            pa.array(np.concatenate([n[first], r_n])),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=FOUND_ARROW)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in lists of about CHUNK_BYTES of text."""
    rows, held = [], 0
    for batch in batches:
        for values in zip(*batch.columns):  # one row at a time
            row = tuple(v.as_py() for v in values)
            rows.append(row)
            held += len(row[2] or "")
            if held >= CHUNK_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _stretches(length: int, anchor: int):
    """(id, tie, text) to the stretches around the anchors."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in _chunks(batches):
            chunk = Chunk(rows, hashes, length)
            if not chunk.rows:
                continue
            first = RangeHashes(chunk.words, BASES[0])
            second = RangeHashes(chunk.words, BASES[1])
            runs = first.of(np.arange(len(chunk.words) - anchor + 1), anchor)
            docs, at = chunk.all_windows()
            anchors = leftmost_least(runs, length - anchor + 1)[at]
            opens = np.ones(len(at), dtype=bool)
            opens[1:] = (anchors[1:] != anchors[:-1]) | (docs[1:] != docs[:-1])
            heads = np.flatnonzero(opens)
            n = np.append(heads[1:], len(at)) - heads
            lo, chosen = at[heads], anchors[heads]
            shape = mix64(((chosen - lo) * 65_536 + n).astype(np.uint64))
            kind = second.of(lo, n + length - 1) ^ shape
            yield chunk.found(runs[chosen], kind, docs[heads], lo, n)

    return seed


def _single_windows(length: int):
    """(id, tie, text, [lo, n, ...]) to the windows of those stretches."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in _chunks(batches):
            chunk = Chunk(rows, hashes, length)
            docs, at = [], []
            for i, row in enumerate(chunk.rows):
                marks = np.array(row[3], dtype=np.int64).reshape(-1, 2)
                asked = np.unique(np.concatenate([np.arange(a, a + n) for a, n in marks]))
                docs.append(np.full(len(asked), i))
                at.append(asked + chunk.starts[i])
            if not docs:
                continue
            docs, at = np.concatenate(docs), np.concatenate(at)
            route = RangeHashes(chunk.words, BASES[0]).of(at, length)
            kind = RangeHashes(chunk.words, BASES[1]).of(at, length)
            yield chunk.found(route, kind, docs, at, np.ones(len(at), np.int64))

    return extend


def _judged(found: DataFrame) -> DataFrame:
    """id, tie, lo, n and `again`: true for repeats, false for the earliest of each kind where other
    kinds exist around the same anchor. Others are left out."""
    place = F.struct("id", "tie", "lo")
    same = Window.partitionBy("route", "kind")
    anchor = Window.partitionBy("route")
    return (
        found.withColumn("least", F.min(place).over(same))
        .withColumn("other", F.min("kind").over(anchor) != F.max("kind").over(anchor))
        .withColumn("again", F.col("kind").isNull() | (place > F.col("least")))
        .where(F.col("again") | F.col("other"))
        .select("id", "tie", "lo", "n", "again")
    )


def _by_document(marks: DataFrame) -> DataFrame:
    """One row per document with its stretches as [lo, n, lo, n, ...]: repeats, and unsettled."""

    def flat(condition) -> F.Column:
        pairs = F.collect_list(F.when(condition, F.array("lo", "n")))
        return F.flatten(pairs)

    return marks.groupBy("id", "tie").agg(
        flat(F.col("again")).alias("repeats"), flat(~F.col("again")).alias("unsettled")
    )


def repeats(
    places: DataFrame, length: int = LENGTH, anchor: int | None = None
) -> DataFrame:
    """The repeated stretches of each document of (id, tie, text): id, tie, repeats [lo, n, ...]."""
    anchor = anchor or max(1, 2 * length // 5)
    seeds = places.mapInArrow(lean(_stretches(length, anchor)), FOUND)
    marks = stored(_by_document(_judged(seeds)), "substring-marks")
    asked = marks.where(F.size("unsettled") > 0).select("id", "tie", "unsettled")
    texts = places.join(asked, ["id", "tie"]).select("id", "tie", "text", "unsettled")
    singles = _judged(texts.mapInArrow(lean(_single_windows(length)), FOUND))
    more = singles.where("again").groupBy("id", "tie").agg(
        F.flatten(F.collect_list(F.array("lo", "n"))).alias("repeats")
    )
    both = marks.where(F.size("repeats") > 0).select("id", "tie", "repeats").unionByName(more)
    return both.groupBy("id", "tie").agg(F.flatten(F.collect_list("repeats")).alias("repeats"))


def covered(n_words: int, spans: list[int] | None, length: int) -> np.ndarray:
    """Which words lie in the windows of [lo, n, lo, n, ...]."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    if spans:
        lo, n = np.asarray(spans, dtype=np.int64).reshape(-1, 2).T
        np.add.at(edges, lo, 1)
        np.add.at(edges, lo + n + length - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(
    df: DataFrame,
    length: int = LENGTH,
    key: str = "doc_id",
    text: str = "text",
    anchor: int | None = None,
) -> DataFrame:
    """`df` with n_words, n_removed, kept_text (kept words joined by one space) and `removed`, the
    maximal repeats as [first word, number of words, ...]."""
    names = ("n_words", "n_removed", "kept_text", "removed")
    rows = df.drop(*names).withColumns(
        {
            "__id": F.coalesce(F.col(key).cast("long"), F.lit(LONG_MAX)),
            "__tie": F.hash(F.coalesce(text, F.lit(""))),
        }
    )
    places = rows.select(
        F.col("__id").alias("id"), F.col("__tie").alias("tie"), F.col(text).alias("text")
    )
    spans = repeats(places, length, anchor).select(
        F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("repeats").alias("__repeats")
    )

    def cut(held: str | None, found: list[int] | None) -> tuple:
        words = words_of(held)
        drop = covered(len(words), found, length)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
        lo, end = edges[::2], edges[1::2]
        kept = b" ".join([w for w, d in zip(words, drop.tolist()) if not d])
        removed = np.stack([lo, end - lo], axis=1).ravel().tolist()
        return len(words), int(drop.sum()), kept.decode("utf-8"), removed

    fields = "n_words long, n_removed long, kept_text string, removed array<long>"
    joined = rows.join(spans, ["__id", "__tie"], "left").drop("__id", "__tie")
    return add_columns(joined, [text, "__repeats"], fields, lambda: cut).drop("__repeats")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 20 words that also start earlier."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(documents)
    return done.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )

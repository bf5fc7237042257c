"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

A token covers bytes of the text: row i of the incidence matrix A (tokens by bytes) has a one in each
of them, and so has B for the other tokenizer. The product A B^T links tokens that overlap, with the
number of common bytes. Where tokens of both end at the same byte, a group ends; with the incidence
of tokens and groups, G = A H (H: bytes by groups), the product G_A G_B^T links all tokens of a group.
Matrices are in compressed rows, built by hand, and products are Gustavson's: for each entry (i, k)
of the left matrix, row k of the right one is added to row i.

Both tokenizers split a text before a single space between other characters, around a single line feed
between others, and before a full stop or comma that ends a word, whatever stands around. So a text is
a sequence of units, which are aligned alone, in large batches, once for each unit that a worker has not
seen lately. That no piece of the vocabulary crosses such a place is checked when the tokenizers are
loaded; a vocabulary with such pieces is an error.

How many documents hold a pair of ids linked is counted over all documents: chunks of documents list
their distinct pairs, so a pair that nearly all documents hold sends one row per chunk. The counts go
back to the chunks' pairs, and each document adds up its links by index. No table of pairs is
broadcast, and no pair or document is left out.

Cases: texts that are null, empty, or that a tokenizer doesn't give back byte by byte (a literal U+2581
reads as a space) have no tokens; ties for an id's most frequent partner all count; repeated rows
count as documents of their own; texts of any length are aligned whole; an empty table gives an empty
result; other columns than the key are not needed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from forgepulse.llm.common import stored, table
from forgepulse.llm.token_counts import byte_level_alphabet

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

UNIT_END = re.compile(
    r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,](?:\s|$))"
)
CROSSES_UNITS = re.compile(r"[^▁]▁+[^▁]|\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,]")
UNITS = 200_000
"""A worker that holds more at the end of a chunk forgets those that only one chunk has used since it
last forgot any; where more than half would stay, it forgets all."""

CHUNK_CHARS = 1 << 21
ID_BITS = 32


class Csr(NamedTuple):
    """A sparse matrix by compressed rows: row i has columns[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1


def csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> Csr:
    """From entries in any order; entries of one place are added."""
    key = rows.astype(np.int64) * max(shape[1], 1) + columns
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    added = np.add.reduceat(values, first) if len(first) else values
    key = key[first]
    counts = np.bincount(key // max(shape[1], 1), minlength=shape[0])
    return Csr(np.r_[0, np.cumsum(counts)], key % max(shape[1], 1), added, shape[1])


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, of consecutive tokens that end before the bytes `ends`."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends], np.arange(total), np.ones(total, np.int64), total)


def row_numbers(m: Csr) -> np.ndarray:
    return np.repeat(np.arange(m.height), np.diff(m.starts))


def transposed(m: Csr) -> Csr:
    return csr(m.columns, row_numbers(m), m.values, (m.width, m.height))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return np.arange(total) + shift if total else np.zeros(0, np.int64)


def product(left: Csr, right: Csr) -> Csr:
    """Gustavson's product: each entry (i, k) of the left adds row k of the right to row i."""
    lengths = np.diff(right.starts)[left.columns]
    taken = spread(right.starts[left.columns], lengths)
    rows = np.repeat(row_numbers(left), lengths)
    values = np.repeat(left.values, lengths) * right.values[taken]
    return csr(rows, right.columns[taken], values, (left.height, right.width))


class Links(NamedTuple):
    overlaps: Csr
    """A's tokens by B's: the number of common bytes."""
    groups_a: Csr
    groups_b: Csr
    """Tokens by groups: the number of a token's bytes in the group."""
    shared: Csr
    """A's tokens by B's: entries where a group holds both."""


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Links:
    """Links of two tokenizations of the same bytes, by the ends of their tokens."""
    a, b = incidence(ends_a), incidence(ends_b)
    cuts = np.intersect1d(ends_a, ends_b)
    total = a.width
    group_of = np.searchsorted(cuts, np.arange(total), side="right")
    bytes_of = Csr(np.arange(total + 1), group_of, np.ones(total, np.int64), len(cuts))
    groups_a, groups_b = product(a, bytes_of), product(b, bytes_of)
    return Links(
        product(a, transposed(b)), groups_a, groups_b, product(groups_a, transposed(groups_b))
    )


class Tokenizers:
    """Both libraries, and the bytes of every id."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        letters = byte_level_alphabet()
        with open(byte_file, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in letters for c in entry):
                self.bytes_a[i] = bytes(letters[c] for c in entry)
        self.bytes_b = []
        for i in range(len(self.second)):
            piece = self.second.id_to_piece(i)
            if CROSSES_UNITS.search(piece):
                raise ValueError(f"piece {piece!r} crosses the end of a unit")
            if self.second.is_byte(i):
                self.bytes_b.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
        self.lengths = [
            np.fromiter(map(len, held), np.int64, len(held)) for held in (self.bytes_a, self.bytes_b)
        ]
        self.names = [list(map(str, range(len(held)))) for held in (self.bytes_a, self.bytes_b)]
        # A space of its own goes before a text, so units that don't begin with one follow a line feed.
        self.lead = self.second.encode("\n")

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit by both; none where bytes aren't given back."""
        first = [e.ids for e in self.first.encode_batch(units, add_special_tokens=False)]
        second = self.second.encode(
            [u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1
        )
        lead = len(self.lead)
        for i, unit in enumerate(units):
            if unit[0] != " ":
                second[i] = second[i][lead:]
        whole = "".join(units).encode()
        sizes = [len(u) if u.isascii() else len(u.encode()) for u in units]
        for ids, bytes_of, lengths in (
            (first, self.bytes_a, self.lengths[0]), (second, self.bytes_b, self.lengths[1])
        ):
            flat = list(chain.from_iterable(ids))
            tokens = np.fromiter(map(len, ids), np.int64, len(ids))
            covered = np.r_[0, np.cumsum(lengths[flat])][np.r_[0, np.cumsum(tokens)]]
            if b"".join(map(bytes_of.__getitem__, flat)) != whole or (
                np.diff(covered) != sizes
            ).any():
                for i, unit in enumerate(units):
                    if b"".join(map(bytes_of.__getitem__, ids[i])) != unit.encode():
                        first[i], second[i] = [], []
        return first, second


class Units:
    """The alignment of each unit by its number."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str | None] = []
        self.sizes = np.zeros((0, 3), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.chunks = np.zeros(0, np.int32)
        """In how many chunks each unit has been used."""

    def used(self, numbers: list[np.ndarray]) -> None:
        """Count a chunk for the units of its documents; forget rare ones if there are too many."""
        in_chunk = np.zeros(len(self.number), bool)
        for own in numbers:
            in_chunk[own] = True
        before = np.r_[self.chunks, np.zeros(len(in_chunk) - len(self.chunks), np.int32)]
        self.chunks = before + in_chunk
        if len(self.number) > UNITS:
            kept = np.flatnonzero(self.chunks > 1)
            if len(kept) > UNITS // 2:
                self.clear()
            else:
                self._keep(kept)

    def _keep(self, kept: np.ndarray) -> None:
        units, shown = list(self.number), self.shown
        lengths = np.diff(self.starts)[kept]
        self.pairs = self.pairs[spread(self.starts[kept], lengths)]
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.sizes = self.sizes[kept]
        self.shown = [shown[i] for i in kept.tolist()]
        self.number = {units[i]: n for n, i in enumerate(kept.tolist())}
        self.chunks = np.zeros(len(kept), np.int32)

    def learn(self, units: list[str]) -> None:
        """Align new units in one batch: their matrices lie side by side on the diagonal."""
        coded = self.tokenizers.encoded(units)
        for i, unit in enumerate(units, len(self.number)):
            self.number[unit] = i
        sizes = np.array([list(map(len, side)) for side in coded], np.int64).T
        flat = [list(chain.from_iterable(side)) for side in coded]
        ids = [np.array(held, np.int64) for held in flat]
        links = align(
            *[np.cumsum(lengths[held]) for lengths, held in zip(self.tokenizers.lengths, ids)]
        )
        # Tokens of a unit, its links and its groups are consecutive.
        token_ends = np.r_[0, np.cumsum(sizes[:, 0])]
        link_ends = links.shared.starts[token_ends]
        rows = row_numbers(links.shared)
        found = (ids[0][rows] << ID_BITS) | ids[1][links.shared.columns]
        group_ends = np.r_[0, links.groups_a.columns + 1][token_ends]  # a token is in one group
        self.starts = np.r_[self.starts, self.starts[-1] + link_ends[1:]]
        self.pairs = np.r_[self.pairs, found]
        self.sizes = np.r_[self.sizes, np.c_[sizes, np.diff(group_ends)]]
        groups = self._groups(flat, links)
        ends = group_ends.tolist()
        self.shown += [
            (groups[lo] if hi == lo + 1 else ";".join(groups[lo:hi])) if hi > lo else None
            for lo, hi in zip(ends, ends[1:])
        ]

    def _groups(self, flat: list[list[int]], links: Links) -> list[str]:
        """Each group as text: its ids of A and of B."""
        sides = []
        for held, names, m in zip(flat, self.tokenizers.names, (links.groups_a, links.groups_b)):
            texts = list(map(names.__getitem__, held))
            ends = np.searchsorted(m.columns, np.arange(m.width), side="right").tolist()
            sides.append([
                texts[lo] if hi == lo + 1 else ",".join(texts[lo:hi])
                for lo, hi in zip([0, *ends], ends)
            ])
        return [f"{a}|{b}" for a, b in zip(*sides)]

    def of(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The numbers of each text's units; None for texts without tokens."""
        split = [UNIT_END.split(" " + t) if t else [] for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(split)) if u not in self.number]
        if new:
            self.learn(new)
        number = self.number.__getitem__
        out = []
        for units in split:
            own = np.fromiter(map(number, units), np.int64, len(units))
            # A unit whose bytes aren't given back has no groups.
            out.append(own if units and self.sizes[own, 2].all() else None)
        return out


_held: dict[tuple[str, str], Units] = {}


def _units(byte_file: str, piece_file: str) -> Units:
    """One per worker process, so that units are remembered over tasks."""
    key = (byte_file, piece_file)
    if key not in _held:
        _held.clear()
        _held[key] = Units(Tokenizers(*key))
    return _held[key]


SIZES = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
         "groups_sha256": "string"}


def _chunk(units: Units, keys: pa.Array, texts: list[str | None], name: str, schema: pa.Schema):
    """One row: the distinct pairs of some documents, and each document's links as their indexes."""
    held = units.of(texts)
    number, rows = [], []
    for own in held:
        if own is None:
            rows.append((0, 0, 0, 0, "", None))
            continue
        groups = ";".join([units.shown[i] for i in own.tolist()])
        sizes = units.sizes[own].sum(axis=0).tolist()
        starts = units.starts[own]
        pairs = units.pairs[spread(starts, units.starts[own + 1] - starts)]
        distinct, times = np.unique(pairs, return_counts=True)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        rows.append((*sizes, len(pairs), digest, times.astype(np.int32)))
        number.append(distinct)
    flat = np.concatenate(number) if number else np.zeros(0, np.int64)
    pairs, place, in_docs = np.unique(flat, return_inverse=True, return_counts=True)
    place, at = place.astype(np.int32), 0
    documents = []
    for key, (n_a, n_b, n_groups, n_links, digest, times) in zip(keys.to_pylist(), rows):
        size = 0 if times is None else len(times)
        documents.append(
            {
                "key": key, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups_sha256": digest, "places": place[at : at + size].tobytes(),
                "times": b"" if times is None else times.tobytes(),
            }
        )
        at += size
    units.used([own for own in held if own is not None])
    columns = [[name], [pairs], [in_docs.astype(np.int64)], [documents]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def chunks(df: DataFrame, byte_file: str, piece_file: str, key: str, text: str) -> DataFrame:
    """Aligned documents in chunks of bounded text: `chunk`, `pairs`, `in_docs`, `documents`."""
    fields = {"key": df.schema[key].dataType.simpleString(), **SIZES,
              "places": "binary", "times": "binary"}
    document = ",".join(f"{name}:{kind}" for name, kind in fields.items())
    schema = StructType.fromDDL(
        "chunk string, pairs array<long>, in_docs array<long>, "
        f"documents array<struct<{document}>>"
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, n = _units(byte_file, piece_file), TaskContext.get().partitionId(), 0
        keys, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(1)
            for i in range(batch.num_rows):
                texts.append(column[i].as_py())
                keys.append(batch.column(0).slice(i, 1))
                size += len(texts[-1] or "") + 32
                if size >= CHUNK_CHARS:
                    yield _chunk(units, pa.concat_arrays(keys), texts, f"{part}-{n}", arrow)
                    keys, texts, size, n = [], [], 0, n + 1
        if keys:
            yield _chunk(units, pa.concat_arrays(keys), texts, f"{part}-{n}", arrow)

    return df.select(key, text).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """`pair`, in how many documents it is linked (`count`), and whether no other of its A id is in
    more (`best`). Counts of a chunk are added before the shuffle and after it."""
    rows = aligned.select(F.inline(F.arrays_zip("pairs", "in_docs")).alias("pair", "n"))
    counts = stored(rows.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts")
    most = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(
        F.max("count").alias("most")
    )
    return counts.join(most, F.shiftright("pair", ID_BITS) == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the counts of their pairs, as documents with sums over their links."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts = np.asarray(batch.column("counts")[i].values)
            best = np.asarray(batch.column("bests")[i].values.cast(pa.int64()))
            documents = batch.column("documents")[i].values
            n_best, count_sum = [], []
            for places, times in zip(documents.field("places"), documents.field("times")):
                at = np.frombuffer(places.as_buffer(), np.int32)
                often = np.frombuffer(times.as_buffer(), np.int32).astype(np.int64)
                n_best.append(int(often @ best[at]))
                count_sum.append(int(often @ counts[at]))
            names = ["key", *SIZES]
            arrays = [documents.field(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                names=[*names, "n_best", "count_sum"],
            )


def alignment(
    df: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `df`: `key`, sizes of its alignment, and its links weighed by corpus-wide counts."""
    aligned = stored(chunks(df, byte_file, piece_file, key, text), "alignment-chunks")
    held = aligned.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    weighed = held.join(pair_counts(aligned), "pair")
    # A chunk's pairs are bounded by its text.
    back = (
        weighed.groupBy("chunk")
        .agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("found"))
        .select("chunk", F.col("found.count").alias("counts"), F.col("found.best").alias("bests"))
    )
    empty = F.array()
    joined = aligned.select("chunk", "documents").join(back, "chunk", "left")
    sizes = ", ".join(f"{name} {kind}" for name, kind in SIZES.items())
    done = joined.select(
        "documents",
        F.coalesce("counts", empty.cast("array<long>")).alias("counts"),
        F.coalesce("bests", empty.cast("array<boolean>")).alias("bests"),
    ).mapInArrow(
        _summed,
        f"key {df.schema[key].dataType.simpleString()}, {sizes}, n_best long, count_sum long",
    )
    return done.withColumnRenamed("key", key)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the two tokenizers."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path
    return alignment(documents, path(BYTE_FILE), path(PIECE_FILE)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )

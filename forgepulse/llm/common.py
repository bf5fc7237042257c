"""Helpers shared by the operators: tables, the shared folder, hashes, ordered ranges."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LONG_MAX = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Unset, a local session gets a temporary folder of its own; a cluster session is an error, as
    each machine would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="forgepulse-"))
    return context.getCheckpointDir().rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files behind when they are done."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written once to the shared folder and read again: lineage ends at the files.

    So the shuffles behind it are of no more use, and their files go when the write is done, not
    whenever the driver's garbage is next collected.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_fold(key: Column, folds: int) -> Column:
    """The unsigned CRC-32 of the key's text, modulo `folds`."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by ':'.

    A null part counts as the text 'null'. MD5 and powers of two give the same draw in any engine.
    """
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(
        float(1 << 52)
    )


def row_position(df: DataFrame, salt: str) -> Column:
    """A number in [0, 1) hashed from the whole row, so that copies of a text differ by their ids.

    Columns with maps, which have no hash, are left out.
    """
    columns = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]
    return F.xxhash64(*columns, F.lit(salt)).cast("double") / F.lit(2.0**64) + F.lit(0.5)


MAX_BUCKETS = 4096


def range_edges(df: DataFrame, key: str, rows: int, per_bucket: int = 20_000) -> list[int]:
    """Ascending cut points of a long column, for buckets of about `per_bucket` rows.

    At most MAX_BUCKETS - 1 numbers come to the driver; buckets of larger tables hold more rows.
    Quantiles are approximate, buckets are exact: a bucket is a function of the key alone.
    """
    buckets = min(MAX_BUCKETS, max(1, -(-rows // per_bucket)))
    if buckets == 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.percentile_approx(key, shares, 10 * buckets).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def bucket_of(key: Column, edges: Sequence[int]) -> Column:
    """Index of the range that holds a non-null long: the number of edges at or below it."""
    if not edges:
        return F.lit(0)
    cuts = np.array(edges, dtype=np.int64)

    @F.pandas_udf("int")
    def search(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), side="right"))

    return search(key)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word; a bounded number of words is remembered."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.where(_SPACES, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _BASE), dtype=np.uint64)
WORDS_SLICE = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, as `words_of` cuts them, without a step per word.

    A polynomial over scrambled bytes, scrambled with the length. Bytes are taken in slices of whole
    words, so memory beyond the text is bounded by WORDS_SLICE and the longest word.
    """
    held = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACES[held], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + WORDS_SLICE, side="right")))
        first, last = starts[lo], ends[hi - 1]
        own = starts[lo:hi] - first
        lengths = np.diff(np.append(own, last - first))
        at = np.arange(last - first) - np.repeat(own, lengths)
        powers = _POWERS
        if lengths.max() > len(powers):
            powers = np.cumprod(np.full(int(lengths.max()), _BASE), dtype=np.uint64)
        sums = np.add.reduceat(_LETTERS[held[first:last]] * powers[at], own)
        out[lo:hi] = mix64(sums + (ends[lo:hi] - starts[lo:hi]).astype(np.uint64) * _MIX2)
        lo = hi
    return out


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than space, tab, line feed, vertical tab, form feed and return."""
    return text.encode("utf-8").split() if text else []


class RangeHashes:
    """Hashes of any range of a sequence of 64-bit integers, from one pass over it.

    A polynomial in an odd base modulo 2**64, scrambled. Two bases give 128 bits.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = self._powers_of(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    @classmethod
    def _powers_of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, 1 << 16)
            held = tuple(
                np.concatenate(
                    [
                        np.ones(1, np.uint64),
                        np.cumprod(np.full(size - 1, b, dtype=np.uint64), dtype=np.uint64),
                    ]
                )
                for b in (base, pow(base, -1, 1 << 64))
            )
            cls._powers[base] = held
        return held

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.down[start])


_at_end: list[Callable[[], None]] = [RangeHashes._powers.clear]
"""What frees the memory that modules keep between calls."""


def at_task_end(free: Callable[[], None]) -> None:
    _at_end.append(free)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for `mapInArrow`, giving memory back when its task ends: workers are used again by other
    stages, and what they keep adds up within an executor."""

    @functools.wraps(run)
    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for free in _at_end:
                free()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # other C libraries give memory back by themselves

    return ran


SLICE_CHARS = 1 << 21


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: str,
    make: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """`df` with the columns of `fields` (a DDL schema), computed row by row in Python.

    `make` is called once per task and returns a function from the inputs of a row to a tuple. Rows
    leave in slices of about SLICE_CHARS of input, so a worker holds one Arrow batch as it came and a
    slice of results. Columns of the same names are replaced.
    """
    added = StructType.fromDDL(fields)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]
    taken = [c for c in df.columns if c.lower() in names and c not in inputs]
    source = df.drop(*taken)
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()

        def sliced(batch: pa.RecordBatch, lo: int, rows: list[tuple]) -> pa.RecordBatch:
            part = batch.slice(lo, len(rows))
            arrays = [part.column(f.name) for f in kept]
            arrays += [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + arrow.names)

        for batch in batches:
            columns = [batch.column(c) for c in inputs]
            lo, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in columns]
                rows.append(compute(*values))
                held += sum(len(v) for v in values if isinstance(v, str | bytes))
                if held >= SLICE_CHARS:
                    yield sliced(batch, lo, rows)
                    lo, rows, held = i + 1, [], 0
            if rows:
                yield sliced(batch, lo, rows)

    return source.mapInArrow(lean(run), StructType([*kept, *added.fields]))

"""N-gram Jaccard join by parity sketches, and the groups it links.

Documents become sets of distinct word shingles. A set of up to h shingles has a sketch of M words:
every shingle XORs its 64-bit hash into the word that another hash picks. A shingle in only one of two sets
changes one word at most, so the number of words that differ (their Hamming distance) is a lower bound
of the symmetric difference. At a similarity of p percent that is at most (100 - p) / (100 + p) of
both sizes together, less than M; by the pigeonhole principle some word of the two sketches is equal.
Sketches are therefore joined on (band, position, word), and what meets is verified exactly.

Size bands. M depends on the band of the set's size; a set also enters the next band if a partner
could lie there.

Choice of words. Words made of few shingles say little. Only words of at least `least_count`
shingles are joined. A set with d differences allowed is caught if more than d of its words are used; a set
with fewer is sketched again with another hash, and after LEVELS tries all its words are used.
A linked pair meets at the first level at which one of both has enough, as both took part in all
levels before; so no link is lost.

Groups. Equal sets are one node. In a bucket of equal words all sets are verified against its least
member only, never all pairs. Where the links found so far leave several components in a
bucket, its sets are compared by finer sketches. Small buckets send pairs of signatures, which are
combined before sketches are looked up, as the same sets meet in many buckets; of the pairs that the
bound lets pass, one of each set is verified, then those not connected yet. In larger buckets sketches
are compared in blocks of BLOCK sets; of the pairs that pass, a forest that would connect the same sets
is verified. Where one of these fails, all pairs of the bucket that pass and are not yet connected are
verified. Then two linked sets are always in one component, and the pairs that leave a block are fewer
than its sets.

Scale. Sets equal in a word within one chunk of documents are joined at once to the chunk's least, so a
group of copies that holds a third of all rows sends one row per chunk and word to a reducer. What is
shuffled are two or three longs per word and the texts of sets that met. Nothing is collected.

Cases: a null text and one without words has an empty set and is linked with nothing, not even with
other empty ones; fewer words than a shingle make one shingle; A-Z count as a-z; repeated rows and
equal texts are linked (similarity 1) unless empty; null ids have no smallest id to offer: a group of
null ids only has a null component_id; an empty table gives an empty result; input columns named
like a result column are replaced. Identity of sets rests on 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgepulse.llm.common import (
    add_columns,
    lean,
    mix64,
    shuffle_parts,
    stored,
    table,
    word_hashes,
)
from forgepulse.llm.components import connected

SHINGLE = 5
PERCENT = 80
BAND_RATIO = 2
LEVELS = 4
MARGIN = 1.12
BLOCK = 512
CHUNK_BYTES = 4 << 20
U = np.uint64


class Band(NamedTuple):
    index: int
    low: int
    high: int
    words: int


class Plan(NamedTuple):
    """What the sketches of a threshold look like."""

    shingle: int
    percent: int
    least_count: int
    load: float
    """Shingles per word of the largest sets of a band."""

    def allowed(self, size: int) -> int:
        """The most differences that a set may have with a partner of any size."""
        return size * (100 - self.percent) // self.percent

    def apart(self, total):
        """The most differences that two sets of so many shingles together may have."""
        return total * (100 - self.percent) // (100 + self.percent)

    def bands(self, size: int) -> list[Band]:
        """The bands a set of this size enters: its own, and the next if a partner may be there."""
        index, low, high = 0, 1, 2
        while high < size:
            index, low, high = index + 1, high + 1, high * BAND_RATIO
        found = [self._band(index, low, high)]
        if size * 100 >= self.percent * (high + 1):
            found.append(self._band(index + 1, high + 1, high * BAND_RATIO))
        return [b for b in found if b.words > 1]  # else only equal sets are linked

    def _band(self, index: int, low: int, high: int) -> Band:
        most = self.apart(2 * high)
        return Band(index, low, high, max(most + 1, math.ceil(high / self.load)) if most else 1)


def plan_for(shingle: int = SHINGLE, percent: int = PERCENT) -> Plan:
    """The largest count per word, and then load, at which sets of a band have enough words."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    needed = MARGIN * (100 - percent) / percent

    def enough(load: float, count: int) -> bool:
        fewer = sum(math.exp(-load) * load**i / math.factorial(i) for i in range(count))
        return (1 - fewer) / load >= needed

    for count in range(8, 0, -1):
        for load in np.arange(40.0, 0.4, -0.1):
            if enough(load, count) and enough(load / BAND_RATIO, count):
                return Plan(shingle, percent, count, float(load))
    return Plan(shingle, percent, 1, 1.0)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = word_hashes(text.encode("utf-8").lower() if text else b"")
    if not len(words):
        return words
    k = min(shingle, len(words))
    n = len(words) - k + 1
    value = np.full(n, k, dtype=U)
    for i in range(k):
        value = value * U(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(mix64(value))


def signature(members: np.ndarray) -> int:
    """One number for a set; 0 for the empty one."""
    if not len(members):
        return 0
    spread = mix64(members)
    folded = np.array([spread.sum(dtype=U), np.bitwise_xor.reduce(spread), U(len(members))])
    mixed = mix64(folded * U(0xD6E8FEB86659FD93) + np.arange(3, dtype=U))
    return int(mix64(mixed.sum(dtype=U, keepdims=True)).view(np.int64)[0]) or 1


class Spread:
    """A set's members in the order of one level's hash: a range of it falls into each word of any
    number of words, so every sketch of the level is read off one running XOR."""

    def __init__(self, members: np.ndarray, level: int) -> None:
        place = mix64(members ^ U((level + 1) * 0xA0761D6478BD642F % (1 << 64))) >> U(32)
        order = np.argsort(place)
        self.place = place[order]
        payload = mix64(members ^ U(0x8BB84B93962EACC9))[order]
        self.so_far = np.concatenate([np.zeros(1, U), np.bitwise_xor.accumulate(payload)])

    def sketch(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The XOR words of the set, and from how many shingles each was made."""
        at = ((self.place * U(words)) >> U(32)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=words))])
        held = self.so_far[ends]
        return held[1:] ^ held[:-1], np.diff(ends)


def bucket_keys(members: np.ndarray, plan: Plan) -> list[tuple[int, np.ndarray]]:
    """(band, keys) of the words to join on."""
    found, levels = [], {}
    for band in plan.bands(len(members)):
        for level in range(LEVELS + 1):
            if level not in levels:
                levels[level] = Spread(members, level)
            values, counts = levels[level].sketch(band.words)
            last = level == LEVELS
            used = np.flatnonzero(counts >= (0 if last else plan.least_count))
            place = U(band.index * (LEVELS + 1) + level) << U(40)
            keys = mix64(mix64(values[used] + counts[used].astype(U)) ^ mix64(place | used.astype(U)))
            found.append((band.index, keys))
            if len(used) > plan.allowed(len(members)):
                break
    return found


MET = "route long, key long, sig long, band int, lead long, size int"
"""A set in a bucket (`key`). The least of its chunk has the route `key`, no lead, and the number of
the chunk's sets in the bucket as size; the others have it as lead, and spread routes."""

MET_ARROW = pa.schema(
    [(c, pa.int32() if c in ("band", "size") else pa.int64())
     for c in ("route", "key", "sig", "band", "lead", "size")]
)


def _text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, str]]:
    """One text of each set, by signature, in chunks of about CHUNK_BYTES."""
    texts, held = {}, 0
    for batch in batches:
        sigs = batch.column(0).to_numpy()
        for i, value in enumerate(batch.column(1)):  # one text at a time
            if sigs[i] in texts:
                continue
            texts[sigs[i]] = text = value.as_py()
            held += len(text)
            if held >= CHUNK_BYTES:
                yield texts
                texts, held = {}, 0
    if texts:
        yield texts


def _meet(plan: Plan):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _text_chunks(batches):
            keys, sigs, bands = [], [], []
            for sig, text in texts.items():
                members = shingle_set(text, plan.shingle)
                for band, own in bucket_keys(members, plan):
                    keys.append(own)
                    sigs.append(np.full(len(own), sig, np.int64))
                    bands.append(np.full(len(own), band, np.int32))
            if not keys:
                continue
            key = np.concatenate(keys).view(np.int64)
            sig, band = np.concatenate(sigs), np.concatenate(bands)
            order = np.lexsort((sig, key))
            key, sig, band = key[order], sig[order], band[order]
            opens = np.append(True, key[1:] != key[:-1])
            heads = np.flatnonzero(opens)
            sizes = np.diff(np.append(heads, len(key)))
            lead = np.repeat(sig[heads], sizes)
            spread = mix64(key.view(U) ^ mix64(sig.view(U))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(opens, key, spread)),
                    pa.array(key),
                    pa.array(sig),
                    pa.array(band),
                    pa.array(lead, mask=opens),
                    pa.array(np.where(opens, np.repeat(sizes, sizes), 0).astype(np.int32)),
                ],
                schema=MET_ARROW,
            )

    return meet


def _signed(df: DataFrame, plan: Plan, text: str) -> DataFrame:
    """`df` with the signature and the size of the text's set."""

    def make():
        def signed(held: str | None) -> tuple[int, int]:
            members = shingle_set(held, plan.shingle)
            return signature(members), len(members)

        return signed

    return add_columns(df, [text], "__sig long, __size long", make)


def _verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The linked ones of (a, b) pairs of signatures; b's side may be hot and is not moved twice."""

    def make():
        last: list = ["", np.empty(0, U)]

        def linked(x: str, y: str) -> tuple[bool]:
            if last[0] != y:
                last[:] = [y, shingle_set(y, plan.shingle)]
            a, b = shingle_set(x, plan.shingle), last[1]
            common = len(np.intersect1d(a, b, assume_unique=True))
            return (100 * common >= plan.percent * (len(a) + len(b) - common),)

        return linked

    one = texts.select(F.col("sig").alias("a"), F.col("text").alias("x"))
    other = texts.select(F.col("sig").alias("b"), F.col("text").alias("y"))
    met = pairs.join(one, "a").join(other, "b")
    return add_columns(met, ["x", "y"], "ok boolean", make).where("ok").select("a", "b")


FINE = 2
"""Words of the sketches that are compared, per word of those that are joined."""


def _sketches(plan: Plan):
    """(sig, text) to (sig, band, size, words): 8 bits of each word of a finer sketch."""
    schema = pa.schema(
        [("sig", pa.int64()), ("band", pa.int32()), ("size", pa.int32()), ("words", pa.binary())]
    )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sig, text in zip(*batch.columns):
                members = shingle_set(text.as_py(), plan.shingle)
                spread = Spread(members, 0)
                for band in plan.bands(len(members)):
                    words = spread.sketch(FINE * band.words)[0].astype(np.uint8).tobytes()
                    rows.append((sig.as_py(), band.index, len(members), words))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return made


def near_pairs(
    sigs: list[int],
    roots: list[int],
    sizes: list[int],
    words: np.ndarray,
    first: int,
    plan: Plan,
    every: bool,
) -> list[tuple[int, int]]:
    """Pairs of different roots that the sketches' bound lets pass, in one pair of blocks.

    The first `first` sets are compared with the others, or, if there are no others, with each
    other. Unless `every`, pairs that earlier ones would connect already are left out.
    """
    within = first == len(sigs)
    label = {r: r for r in roots}

    def root_of(r: int) -> int:
        while label[r] != r:
            label[r] = label[label[r]]
            r = label[r]
        return r

    size, found = np.array(sizes), []
    for x in range(first):
        low = x + 1 if within else first
        apart = np.count_nonzero(words[low:] != words[x], axis=1)
        for y in np.flatnonzero(apart <= plan.apart(size[low:] + size[x])) + low:
            a, b = (roots[x], roots[y]) if every else (root_of(roots[x]), root_of(roots[y]))
            if a != b:
                found.append((sigs[x], sigs[y]))
                if not every:
                    label[b] = a
    return found


def _compare(plan: Plan, every: bool):
    """Sorted (key, i, j, part, sig, root, size, words) to the near pairs of each (key, i, j)."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def settled(place: tuple, rows: list[tuple]) -> list[tuple[int, int, int]]:
        key, i, j = place
        first = len(rows) if i == j else sum(r[0] == i for r in rows)
        words = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        columns = [list(c) for c in zip(*rows)]
        pairs = near_pairs(*columns[1:4], words, first, plan, every)
        return [(key, a, b) for a, b in pairs]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != place:
                    if rows:
                        found += settled(place, rows)
                    place, rows = row[:3], []
                rows.append(row[3:])
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found)], schema=schema
                )
        if rows and (found := settled(place, rows)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*found)], schema=schema
            )

    return compare


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets of three or more sets that are in several components, with the root of
    each set, and `n`, the number of the bucket's rows."""
    rooted = buckets.join(roots, buckets["sig"] == roots["node"], "left").select(
        "key", "sig", "band", "lead", F.coalesce("root", "sig").alias("root")
    )
    open_ = (
        rooted.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
        .where((F.col("n") > 2) & (F.col("x") != F.col("y")))
        .select("key", "n")
    )
    return stored(rooted.join(open_, "key"), "jaccard-open")


PAIRED = 64
PAIR_BYTES = 16
HELD_PAIRS = 1 << 20


def _is_paired(plan: Plan) -> Column:
    """Whether a bucket goes as pairs of signatures: where these take less room than a sketch in each row
    would. Small buckets do in any case, as most of their pairs meet in many of them."""
    sketch = F.pow(F.lit(float(BAND_RATIO)), F.col("band") + 1) * (FINE / plan.load)
    most = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(float(PAIRED)), sketch * 2 / PAIR_BYTES))
    return F.col("n") <= most


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """The distinct columns."""
    held = pairs[:, np.lexsort(pairs)]
    return held[:, np.append(True, (held[:, 1:] != held[:, :-1]).any(axis=0))[: held.shape[1]]]


def bucket_pairs(rows: np.ndarray) -> np.ndarray:
    """(a, b, band) of the pairs in one bucket to compare, from its (key, sig, lead, root, band).

    Sets in one component are connected already; a set and its lead have been verified.
    """
    _, sig, lead, root, band = rows
    i, j = np.triu_indices(len(sig), 1)
    asked = (root[i] != root[j]) & (sig[i] != lead[j]) & (sig[j] != lead[i])
    i, j = i[asked], j[asked]
    return np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), band[i]])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig, lead, root, band) sorted by key to `bucket_pairs`; a pair that met in many buckets of
    the task mostly leaves once."""

    def buckets() -> Iterator[np.ndarray]:
        rest = np.empty((5, 0), np.int64)
        for batch in batches:
            rows = np.hstack([rest, np.stack([c.to_numpy() for c in batch.columns])])
            *whole, rest = np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1)
            yield from whole
        yield rest

    def made(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "band"])

    held, size = [np.empty((3, 0), np.int64)], 0
    for rows in buckets():
        held.append(bucket_pairs(rows))
        size += held[-1].shape[1]
        if size >= HELD_PAIRS:
            held = [_distinct(np.hstack(held))]
            size = held[0].shape[1]
            if size >= HELD_PAIRS // 2:
                yield made(held[0])
                held, size = [held[0][:, :0]], 0
    yield made(_distinct(np.hstack(held)))


def _near(rows: DataFrame, sketches: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) in these buckets that the sketches' bound lets pass, once each."""

    def make():
        def near(x: bytes, y: bytes, total: int) -> tuple[bool]:
            apart = np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))
            return (bool(apart <= plan.apart(total)),)

        return near

    parts = shuffle_parts(rows.sparkSession)
    met = (
        rows.select("key", "sig", "lead", "root", F.col("band").cast("long"))
        .repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(lean(_pairs), "a long, b long, band long")
        .groupBy("a", "b")
        .agg(F.min("band").cast("int").alias("band"))  # any band that both enter will do
    )
    one = sketches.selectExpr("sig AS a", "band", "size AS p", "words AS x")
    other = sketches.selectExpr("sig AS b", "band", "size AS q", "words AS y")
    both = met.join(one, ["a", "band"]).join(other, ["b", "band"])
    sized = both.selectExpr("a", "b", "x", "y", "p + q AS total")
    return add_columns(sized, ["x", "y", "total"], "ok boolean", make).where("ok").select("a", "b")


def _in_blocks(rows: DataFrame, sketches: DataFrame, plan: Plan, every: bool) -> DataFrame:
    """(key, a, b) to verify in larger buckets, compared in blocks."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("sig", "key"), F.col("blocks")).cast("int")
    )
    place = ["key", "i", "j"]
    blocks = (
        dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("part", "with"))
        .withColumn("j", F.greatest("part", "with"))
        .join(sketches, ["sig", "band"])
        .select(*place, "part", "sig", "root", "size", "words")
    )
    parts = shuffle_parts(rows.sparkSession)
    return (
        blocks.repartition(parts, *place)
        .sortWithinPartitions(*place, "part", "sig")
        .mapInArrow(lean(_compare(plan, every)), "key long, a long, b long")
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different components."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(own, end, "left")
    return pairs.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def _buckets(df: DataFrame, plan: Plan) -> DataFrame:
    """(key, sig, band, lead) of the words that several sets of (__sig, text) have.

    Copies of a set come from many chunks; a set is in a bucket once, or twice where it leads in one
    chunk and follows in another.
    """
    met = df.select("__sig", "text").mapInArrow(lean(_meet(plan)), MET)
    bucket = Window.partitionBy("route")
    return (
        met.withColumn("least", F.min("sig").over(bucket))
        .withColumn("most", F.max("sig").over(bucket))
        .withColumn("n", F.max("size").over(bucket))
        .where("lead IS NOT NULL OR least <> most OR n > 1")
        .groupBy("route", "key", "sig", "band")
        .agg(F.min(F.coalesce("lead", "least")).alias("lead"))
        .select("key", "sig", "band", "lead")
    )


def _links(df: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between signatures that connect all linked sets of (__sig, text)."""
    buckets = stored(_buckets(df, plan), "jaccard-buckets")
    pairs = buckets.where(F.col("sig") != F.col("lead")).select(
        F.col("sig").alias("a"), F.col("lead").alias("b")
    ).distinct()
    # One text of each set, combined before the shuffle, so that copies don't move.
    one_each = df.groupBy(F.col("__sig").alias("sig")).agg(F.first("text").alias("text"))
    texts = stored(
        one_each.join(buckets.select("sig").distinct(), "sig", "left_semi"), "jaccard-texts"
    )
    links = stored(_verified(pairs, texts, plan), "jaccard-links")
    open_ = _open(buckets, connected(links))
    needed = open_.select("sig").distinct()
    sketches = stored(
        texts.join(needed, "sig", "left_semi").select("sig", "text").mapInArrow(
            lean(_sketches(plan)), "sig long, band int, size int, words binary"
        ),
        "jaccard-sketches",
    )
    near = stored(_near(open_.where(_is_paired(plan)), sketches, plan), "jaccard-near")
    large = open_.where(~_is_paired(plan))
    # One pair of each set first: what these connect need not be verified.
    asked_near = near.groupBy("a").agg(F.min("b").alias("b"))
    for every in (False, True):
        asked = stored(_in_blocks(large, sketches, plan, every), "jaccard-rest")
        both = asked.select("a", "b").union(asked_near).distinct()
        more = stored(_verified(both, texts, plan), "jaccard-links")
        links = links.union(more)
        if every:
            break
        # Where a pair failed, those left out for its sake are still to be compared.
        failed = asked.join(more, ["a", "b"], "left_anti").select("key").distinct()
        roots = connected(links)
        left = near.join(asked_near, ["a", "b"], "left_anti")
        asked_near = stored(_apart(left, roots), "jaccard-near")
        large = _open(
            large.join(failed, "key", "left_semi").select("key", "sig", "band", "lead"), roots
        )
        if large.isEmpty() and asked_near.isEmpty():
            break
    return links


NAMES = ("n_shingles", "component_id", "group_id")


def _placed(df: DataFrame, plan: Plan, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """`df` with __sig, __size and a number __row; and (__of, __root, __least) of each set that is
    linked or has several rows. What is in neither needs nothing from other rows."""
    numbered = _signed(df, plan, text).withColumn("__row", F.monotonically_increasing_id())
    signed = stored(numbered, "jaccard-sets")
    own = signed.select(F.col(f"`{text}`").alias("text"), "__sig").where("__sig != 0")
    roots = connected(_links(own, plan)).select(
        F.col("node").alias("__sig"), F.col("root").alias("__root")
    )
    roots = roots.union(roots.select("__root", "__root").distinct())
    # One row per set. Few sets have links, and only they take part in finding the least id.
    sets = stored(
        signed.where("__sig != 0")
        .groupBy("__sig")
        .agg(F.min(f"`{key}`").alias("__id"), F.count(F.lit(1)).alias("__rows"))
        .join(roots, "__sig", "left"),
        "jaccard-roots",
    )
    linked = sets.where("__root IS NOT NULL")
    least = _salted(linked.groupBy("__root").agg(F.min("__id").alias("__least")))
    placed = (
        linked.withColumn("__salt", _salt("__sig"))
        .join(least, ["__root", "__salt"])
        .select(F.col("__sig").alias("__of"), "__root", "__least")
    )
    copies = sets.where("__root IS NULL AND __rows > 1").select(
        F.col("__sig").alias("__of"), F.col("__sig").alias("__root"), F.col("__id").alias("__least")
    )
    # Once stored, its size is known where the joins are planned.
    return signed, stored(placed.unionByName(copies), "jaccard-placed")


def _joined(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows with what was found for their set; whichever salt a row draws, it finds the same."""
    dealt = rows.withColumn("__salt", F.floor(F.rand(3) * SALTS))
    held = _salted(found).withColumnRenamed("__salt", "__at")
    return dealt.join(
        held, (F.col("__sig") == F.col("__of")) & (F.col("__salt") == F.col("__at")), how
    )


def groups(
    df: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`df` with n_shingles, the size of the set, component_id, the smallest id of the rows that
    links reach (the row's own if there are none), and group_id, a number of the group that null
    ids have as well (null for empty sets)."""
    signed, found = _placed(df, plan_for(shingle, percent), key, text)
    own = F.col(f"`{key}`")
    return _joined(signed, found, "left").select(
        *[F.col(f"`{c}`") for c in df.columns if c not in NAMES],
        F.col("__size").alias("n_shingles"),
        F.when(F.col("__of").isNull(), own).otherwise(F.col("__least")).alias("component_id"),
        F.when(F.col("__sig") != 0, F.coalesce("__root", "__sig")).alias("group_id"),
    )


def one_of_each(
    df: DataFrame,
    ties: Sequence[str],
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`df` with one row of each group: that of the smallest key (of equal ones the first by `ties`,
    then by a hash of the text). Rows with an empty set are in no group and stay.

    Which rows go is found on narrow columns; texts are moved only where Spark has to shuffle them
    to leave out the numbers of these rows.
    """
    signed, found = _placed(df, plan_for(shingle, percent), key, text)
    order = [f"`{c}`" for c in ties]
    narrow = signed.where("__sig != 0").select(
        "__sig", "__row", F.col(f"`{key}`").alias("__key"),
        F.struct(*order, F.xxhash64(f"`{text}`").alias("__hash"), "__row").alias("__order"),
    )
    members = stored(
        _joined(narrow, found, "inner").select("__row", "__key", "__root", "__least", "__order"),
        "jaccard-members",
    )
    kept = (
        members.where(F.col("__key").eqNullSafe(F.col("__least")))
        .groupBy("__root")
        .agg(F.min("__order")["__row"].alias("__row"))
    )
    gone = stored(members.select("__row").join(kept, "__row", "left_anti"), "jaccard-gone")
    return signed.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


SALTS = 8


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("salt")), F.lit(SALTS).cast("long"))


def _salted(narrow: DataFrame) -> DataFrame:
    """Each row once per salt, so that rows that look for a frequent one are dealt to SALTS tasks."""
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return narrow.withColumn("__salt", F.explode(salts))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by at least 90 percent of common 3-word shingles."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(documents, shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")

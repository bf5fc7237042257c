"""Exact top-k search by inner product with pivot-table elimination.

Components become integers: floor(256 * x). Distances of every vector to a set of pivots are computed
once. For a query q and a vector v the triangle inequality gives, for each pivot p,
|q - v| >= |d(q, p) - d(v, p)|, and the largest of these lower bounds gives an upper bound of the
score: 2 q.v = |q|^2 + |v|^2 - |q - v|^2. Candidates are evaluated in the order of that bound until it
falls below the k-th best score found; then no other vector can enter, so the result is exact.

The stated query set meets all vectors in blocks: each task packs its vectors (and its queries) into
rows of BLOCK vectors, with their pivot distances, and these rows are paired. A task opens one pair of blocks at
a time, beside the Arrow batch of pairs it was sent (64 MB as Spark sets it), whatever the number of vectors or
queries. Each pair yields at most k rows per query, which
are merged by query. Pivots are the first PIVOTS distinct vectors by hash, a bounded sample; they
change the speed, never the result.

Cases: vectors that are null or hold null or non-finite components take no part, neither as queries
nor as candidates; vectors of another length than the query's are not compared with it; components
stay exact up to 64 bits, and products that may outgrow 64 bits are summed as integers of any size; a
component or a best score that 64 bits can't hold is an error, never a wrong number; equal scores go to the smaller id;
rows without id take no part; of repeated ids every row is a candidate, except for queries of that id,
and each row of a repeated query id is answered as one query (the rows' best scores are merged);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgepulse.llm.common import table

BLOCK = 1024
PIVOTS = 32
SCALE = 256
WIDEST = float(1 << 63)
FIRST = 64
"""Candidates evaluated before the first comparison with the bound; doubled each time."""

PACKED = "dims int, ids binary, vectors binary, pivots binary"


def _pack_blocks(pivots: list[list[int]], block: int):
    """Arrow batches of (id, vector) to rows that hold up to `block` vectors of one length."""
    tables = {}
    for p in pivots:
        tables.setdefault(len(p), []).append(p)
    tables = {d: np.array(rows, dtype=np.float64).reshape(-1, d) for d, rows in tables.items()}

    def row(dims: int, ids: list[int], vectors: list[list[int]]) -> dict:
        whole = np.array(vectors, dtype=np.int64).reshape(len(ids), dims)
        matrix = whole.astype(np.float64)
        narrow = matrix.size == 0 or np.abs(matrix).max() < 1 << 31
        near = tables.get(dims)
        distances = (
            np.sqrt(((matrix[:, None, :] - near[None]) ** 2).sum(axis=2))
            if near is not None
            else np.zeros((len(ids), 0))
        )
        return {
            "dims": dims,
            "ids": np.array(ids, dtype=np.int64).tobytes(),
            "vectors": (whole.astype(np.int32) if narrow else whole).tobytes(),
            "pivots": distances.tobytes(),
        }

    schema = pa.schema(
        [("dims", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "pivots"))]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[list[int]]]] = {}
        for batch in batches:
            for id_, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(id_)
                vectors.append(vector)
                if len(ids) == block:
                    yield pa.RecordBatch.from_pylist([row(len(vector), ids, vectors)], schema)
                    del held[len(vector)]
        for dims, (ids, vectors) in held.items():
            yield pa.RecordBatch.from_pylist([row(dims, ids, vectors)], schema)

    return pack


def _largest(vectors: np.ndarray) -> int:
    """Of the absolute components; Python's integer, as the least 64-bit one has no positive."""
    return max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if scores.dtype == object:
        ordered = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
        return np.array(ordered[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def best_of_block(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray],
    block: tuple[np.ndarray, np.ndarray, np.ndarray],
    k: int,
    evaluated: list[int] | None = None,
) -> Iterator[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in the block, ties to smaller ids.

    Each side is (ids, integer vectors, distances to the pivots).
    """
    q_ids, q_vectors, q_pivots = queries
    ids, vectors, pivots = block
    order = np.argsort(ids, kind="stable")
    ids, vectors, pivots = ids[order], vectors[order].astype(np.int64), pivots[order]
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    q_vectors = q_vectors.astype(np.int64)
    fits = _largest(vectors) * _largest(q_vectors) * max(1, vectors.shape[1]) < 1 << 62
    kind = np.int64 if fits else object
    vectors, q_vectors = vectors.astype(kind), q_vectors.astype(kind)
    for q_id, q, to_pivots in zip(q_ids, q_vectors, q_pivots):
        apart = (
            np.abs(pivots - to_pivots).max(axis=1) if pivots.shape[1] else np.zeros(len(ids))
        )
        total = squares + float((q.astype(np.float64) ** 2).sum())
        # Rounding of the distances may not hide a candidate: a millionth of the terms and 1.
        bound = (total - apart**2) / 2 + 1e-6 * total + 1
        bound[ids == q_id] = -np.inf
        candidates = np.argsort(-bound, kind="stable")[: int((ids != q_id).sum())]
        found_ids, found = np.empty(0, np.int64), np.empty(0, kind)
        start, step = 0, max(FIRST, k)
        while start < len(candidates):
            if len(found) == k and bound[candidates[start]] < float(found[-1]):
                break
            part = candidates[start : start + step]
            if len(found) == k:
                part = part[bound[part] >= float(found[-1])]
            if evaluated is not None:
                evaluated.append(len(part))
            all_ids = np.concatenate([found_ids, ids[part]])
            all_scores = np.concatenate([found, vectors[part] @ q])
            best = _best(all_ids, all_scores, k)
            found_ids, found = all_ids[best], all_scores[best]
            start, step = start + step, 2 * step
        for vec_id, score in zip(found_ids.tolist(), found.tolist()):
            yield int(q_id), vec_id, score


def _opened(ids: bytes, vectors: bytes, pivots: bytes, dims: int):
    n = len(ids) // 8
    return (
        np.frombuffer(ids, np.int64),
        np.frombuffer(vectors, np.int32 if len(vectors) == 4 * n * dims else np.int64).reshape(n, dims),
        np.frombuffer(pivots, np.float64).reshape(n, -1) if n else np.zeros((0, 0)),
    )


def _search(k: int):
    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                queries = _opened(row["q_ids"], row["q_vectors"], row["q_pivots"], row["dims"])
                block = _opened(row["ids"], row["vectors"], row["pivots"], row["dims"])
                rows = list(best_of_block(queries, block, k))
                columns = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=schema
                )

    return search


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, all components present and finite."""
    bad = F.exists(
        vector,
        lambda x: x.isNull()
        | F.isnan(x.cast("double"))
        | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.col(vector).isNotNull() & ~bad


def scaled(vector: str) -> Column:
    """floor(256 * x) of every component; an error where 64 bits can't hold it."""

    def whole(x: Column) -> Column:
        large = x.cast("double") * F.lit(float(SCALE))
        return F.when(
            F.abs(large) >= F.lit(WIDEST),
            F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("long"),
        ).otherwise(F.floor(large))

    return F.transform(vector, whole)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other vectors."""

    def prepared(df: DataFrame) -> DataFrame:
        return df.where(usable(vector) & F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("id"), scaled(vector).alias("v")
        )

    pool = prepared(vectors)
    # The rows with the least hashes: a heap of PIVOTS rows in each task, PIVOTS rows on the driver.
    picked = pool.orderBy(F.xxhash64("v", "id"), "id").limit(n_pivots).collect()
    pivots = [list(p) for p in sorted({tuple(r["v"]) for r in picked})]
    pack = _pack_blocks(pivots, block)
    blocks = pool.mapInArrow(pack, PACKED)
    asked = prepared(queries).mapInArrow(pack, PACKED)
    asked = asked.select("dims", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "pivots")])
    # Rows are whole blocks here: the stated query set, in blocks, against all vectors. Each query
    # block goes to every part of the vectors, so that the one value of `dims` is no hot key.
    parts = max(1, 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = blocks.join(asked, ["dims", "part"]).drop("part")
    hits = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

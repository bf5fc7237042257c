"""Mixing sources to target weights by Poisson replication.

A source of size n (bytes of text, rows, or any summed column) whose target share of the mixture is
w gets the repetition rate r = w * total / n. Each document draws its number of copies by inverting
the Poisson distribution of mean r at a number hashed from the seed and the document, so the same
input always gives the same mixture and no state is shared between tasks. Copies are exploded and
dealt out by a hash of document and copy, sorted by it within each part: a global shuffle.

A Poisson number of large mean is a sum of independent ones: r is cut into whole CHUNK parts and a
rest, each with a draw of its own, so the tables of the distribution stay short at any rate.

Only the sizes by source are aggregated (with combining before the shuffle). They are joined by
source in SALTS copies each, so that one source with most rows is split; Spark broadcasts them when it
has measured them as small.

Cases: a null source is a source of its own; sources without a listed weight have `other`; a source
of size 0 (null and empty texts only) has rate 0 and disappears, as do documents that draw 0; null
ids draw by the text 'null' and their text; repeated rows draw alike; an empty table gives an empty result. Input columns
named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgepulse.llm.common import shuffle_parts, table, unit_draw

CHUNK = 16.0
TERMS = 80
"""Terms of a distribution of mean CHUNK at most; what lies beyond has a chance below 1e-27, far
less than the 2**-52 steps of a draw."""

SALTS = 16
SEED = 2024

WEIGHTS = {f"src{i}": float(1 + i % 4) for i in range(20)}
"""Target weights of the registered query: sources in four tiers of 1 to 4."""


def poisson_table(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... of a mean up to CHUNK, as an array."""

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        below = state["below"] + term
        return F.struct(
            term.alias("term"),
            below.alias("below"),
            F.concat(state["sums"], F.array(below)).alias("sums"),
        )

    first = F.exp(-rate)
    start = F.struct(first.alias("term"), first.alias("below"), F.array(first).alias("sums"))
    ks = F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>")
    return F.aggregate(ks, start, step, lambda s: s["sums"])


def invert(sums: Column, draw: Column) -> Column:
    """The smallest k with draw <= P(N <= k)."""
    return F.size(F.filter(sums, lambda below: below < draw))


def mix(
    df: DataFrame,
    weights: Mapping[str, float],
    other: float = 1.0,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    size: Column | None = None,
    total: float | None = None,
    seed: int = SEED,
    copy: str = "copy_no",
    order: str = "shuffle_key",
) -> DataFrame:
    """The mixture: `df`'s rows, each as often as drawn, with the number of the copy (from 1) and
    the hash by which the copies are shuffled.

    `size` is what the weights apply to, the text's bytes by default; `total` is the wanted sum of
    it, that of the input by default.
    """
    if any(w < 0 for w in (*weights.values(), other)):
        raise ValueError("weights must not be negative")
    if size is None:
        size = F.octet_length(text)
    df = df.drop(copy, order)
    listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    weight = F.coalesce(listed[F.col("__source")], F.lit(other)) if weights else F.lit(other)
    sizes = (
        df.select(F.col(source).alias("__source"), F.coalesce(size, F.lit(0)).alias("__size"))
        .groupBy("__source")
        .agg(F.sum("__size").cast("double").alias("__size"))
        .where(F.col("__size") > 0)
        .withColumn("__weight", weight)
    )
    whole = sizes.agg(F.sum("__weight").alias("__weights"), F.sum("__size").alias("__total"))
    goal = F.lit(float(total)) if total is not None else F.col("__total")
    rates = (
        sizes.crossJoin(F.broadcast(whole))  # one row
        .select(
            "__source",
            (F.col("__weight") * goal / (F.col("__weights") * F.col("__size"))).alias("__rate"),
        )
        .withColumn("__chunks", F.floor(F.col("__rate") / CHUNK).cast("long"))
        .withColumn("__rest", poisson_table(F.col("__rate") - F.col("__chunks") * CHUNK))
        .withColumn("__full", F.when(F.col("__chunks") > 0, poisson_table(F.lit(CHUNK))))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    identity = F.when(F.col(key).isNull(), F.md5(F.coalesce(text, F.lit("")))).otherwise(
        F.col(key).cast("string")
    )
    rows = df.withColumns(
        {
            "__id": identity,
            "__salt": F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int"),
            "__of": F.col(source),
        }
    )
    joined = rows.join(
        rates, rows["__of"].eqNullSafe(rates["__source"]) & (rows["__salt"] == rates["__salt"])
    ).drop(rates["__salt"])
    chunks = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("__chunks")),
        lambda i: invert(F.col("__full"), unit_draw(F.lit(seed), F.col("__id"), i)).cast("long"),
    )
    copies = invert(F.col("__rest"), unit_draw(F.lit(seed), F.col("__id"), F.lit(0))) + F.when(
        F.col("__chunks") > 0, F.aggregate(chunks, F.lit(0).cast("long"), lambda a, b: a + b)
    ).otherwise(F.lit(0))
    dealt = (
        joined.withColumn("__copies", copies.cast("long"))
        .where(F.col("__copies") > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        .withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "__id", copy)))
        .select(*[F.col(f"`{c}`") for c in df.columns], copy, order)
    )
    parts = shuffle_parts(df.sparkSession)
    return dealt.repartition(parts, order).sortWithinPartitions(order)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that the bytes of the sources stand as WEIGHTS."""
    mixed = mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select(
        "doc_id", "source", "copy_no", "shuffle_key", F.md5(F.col("text")).alias("text_md5")
    )


def op1_sql() -> str:
    values = ", ".join(f"('{k}', {w})" for k, w in WEIGHTS.items())
    draw = (
        "('0x' || substr(md5('{seed}:' || id || ':' || {i}), 1, 13))::BIGINT::DOUBLE "
        "/ 4503599627370496.0"
    ).replace("{seed}", str(SEED))
    return f"""
WITH RECURSIVE weights(source, w) AS (VALUES {values}),
sizes AS (
  SELECT d.source, sum(octet_length(encode(coalesce(text, ''))))::DOUBLE AS n,
         any_value(coalesce(w, 1.0))::DOUBLE AS w
  FROM documents d LEFT JOIN weights USING (source) GROUP BY d.source
  HAVING n > 0),
rates AS (
  SELECT source, w * (SELECT sum(n) FROM sizes) / ((SELECT sum(w) FROM sizes) * n) AS rate
  FROM sizes),
chunked AS (
  SELECT source, rate, floor(rate / {CHUNK})::BIGINT AS chunks,
         rate - floor(rate / {CHUNK}) * {CHUNK} AS rest FROM rates),
cdf(source, part, mean, k, term, below) AS (
  SELECT source, 0, rest, 0, exp(-rest), exp(-rest) FROM chunked
  UNION ALL SELECT source, 1, {CHUNK}, 0, exp(-{CHUNK}), exp(-{CHUNK}) FROM chunked
  UNION ALL SELECT source, part, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1)
  FROM cdf WHERE k < {TERMS}),
docs AS (
  SELECT doc_id, d.source, text, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS id, chunks
  FROM documents d JOIN chunked c ON d.source IS NOT DISTINCT FROM c.source),
draws AS (
  SELECT doc_id, source, text, id, i, CASE WHEN i = 0 THEN 0 ELSE 1 END AS part,
         {draw.format(i='i')} AS u
  FROM docs, unnest(range(0, chunks + 1)) AS t(i)),
copies AS (
  SELECT doc_id, source, text, id,
         sum(list_count_below)::BIGINT AS n
  FROM (SELECT draws.*, len(list_filter(sums, lambda x: x < u)) AS list_count_below
        FROM draws JOIN (SELECT source, part, list(below ORDER BY k) AS sums
                         FROM cdf GROUP BY source, part) s
        ON s.source IS NOT DISTINCT FROM draws.source AND s.part = draws.part)
  GROUP BY doc_id, source, text, id)
SELECT doc_id, source, c AS copy_no, md5('{SEED}:order:' || id || ':' || c) AS shuffle_key,
       md5(text) AS text_md5
FROM copies, unnest(range(1, n + 1)) AS t(c)
"""

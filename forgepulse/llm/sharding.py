"""Sharding by a hierarchical weighted hash tree (law: `key`).

A row descends from the root through region and rack to a shard. At each node every child draws
-ln(u) / weight, where u is hashed from the row's key and the child's name, and the least draw wins: a
child wins with probability in proportion to its weight. If the weight of a child changes, the draws
of its siblings do not, so rows move only to or from that child: movement is confined to the
subtrees whose weights change. A node's weight is the sum of its shards' weights.

A tree grows by one shard in a region of its own (`grown`): the weights of all other subtrees stay,
so the new shard takes rows and nobody else does. A shard added to an existing rack instead would
also move rows between the shards of its region, as that region's weight grows.

`assign` is a projection (no shuffle). `with_slots` numbers the rows of each shard without gaps: rows
are numbered within ranges of the key, and the counts of the ranges before are added, so a shard is
split over many tasks; one count per shard and range comes to the driver.

Cases: null keys draw by the text 'null'; null texts have size 1; equal keys go to the same
shard, whatever their number; repeated rows get a slot each (which of them gets which is open, as they
are equal); an empty table gives an empty result; an input column named like a result column is
replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgepulse.llm.common import LONG_MAX, bucket_of, range_edges, table, unit_draw

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
"""Region -> rack -> shard -> weight."""

TINY = 2.0**-53


def even_tree(shards: int = 16, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1, `per_rack` to a rack and `racks` to a region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        rack = shard // per_rack
        region = tree.setdefault(f"region{rack // racks}", {})
        region.setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region and rack."""
    return {**tree, f"region+{shard}": {f"rack+{shard}": {shard: weight}}}


def _children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """Name and weight of the children of each inner node; those without weight are left out."""
    below: dict[str, list[tuple[str, float]]] = {"root": []}
    for region, racks in tree.items():
        below[region] = []
        for rack, shards in racks.items():
            below[rack] = [(f"shard{s}", float(w)) for s, w in shards.items() if w > 0]
            if below[rack]:
                below[region].append((rack, sum(w for _, w in below[rack])))
        if below[region]:
            below["root"].append((region, sum(w for _, w in below[region])))
    if not below["root"]:
        raise ValueError("no shard has a weight")
    return {node: found for node, found in below.items() if found}


def _winner(key: Column, children: Column) -> Column:
    """The child with the least draw, by name on a tie."""
    drawn = F.transform(
        children,
        lambda c: F.struct(
            (-F.ln(unit_draw(key, c["name"]) + F.lit(TINY)) / c["weight"]).alias("draw"),
            c["name"].alias("name"),
        ),
    )
    return F.array_min(drawn)["name"]


def assign(df: DataFrame, tree: Tree, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """`df` with the shard of each row."""
    below = _children(tree)
    nodes = F.create_map(
        *[
            x
            for node, found in below.items()
            for x in (
                F.lit(node),
                F.array(
                    *[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in found]
                ),
            )
        ]
    )
    placed = df.withColumn("__node", F.lit("root"))
    for _ in ("region", "rack", "shard"):
        placed = placed.withColumn("__node", _winner(F.col(key), nodes[F.col("__node")]))
    number = F.substring_index("__node", "shard", -1).cast("int")
    return placed.withColumn(shard, number).drop("__node")


def with_slots(
    df: DataFrame, key: str = "doc_id", shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """`df` with a gapless number from 0 within the shard, by ascending key (null first)."""
    low = F.lit(-LONG_MAX - 1)
    keys = df.select(F.coalesce(F.col(key).cast("long"), low).alias("__at"), shard)
    edges = range_edges(keys, "__at", keys.count())
    keys = keys.withColumn("__bucket", bucket_of(F.col("__at"), edges))
    counts = keys.groupBy(shard, "__bucket").count()
    before = counts.select(
        F.col(shard).alias("__shard"),
        F.col("__bucket").alias("__range"),
        (
            F.sum("count").over(Window.partitionBy(shard).orderBy("__bucket")) - F.col("count")
        ).alias("__before"),
    )
    rows = df.withColumn("__at", F.coalesce(F.col(key).cast("long"), low))
    rows = rows.withColumn("__bucket", bucket_of(F.col("__at"), edges))
    within = Window.partitionBy(shard, "__bucket").orderBy("__at")
    numbered = rows.withColumn("__number", F.row_number().over(within))
    joined = numbered.join(
        F.broadcast(before),  # one row per shard and range: shards x MAX_BUCKETS at most
        (numbered[shard] == before["__shard"]) & (numbered["__bucket"] == before["__range"]),
    )
    return joined.withColumn(slot, F.col("__before") + F.col("__number") - 1).drop(
        "__at", "__bucket", "__number", "__shard", "__range", "__before"
    )


def write_shards(df: DataFrame, folder: str, shard: str = "shard") -> None:
    """Parquet files below one folder per shard; rows of a shard come from many tasks."""
    df.write.partitionBy(shard).parquet(folder)


SHARDS = 16


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document among 16, its slot there, and its shard among 17."""
    tree = even_tree(SHARDS)
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(sized, tree), grown(tree, SHARDS), shard="grown_shard")
    return with_slots(placed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def _sql_descend(tree: Tree) -> str:
    """The descent as nested CASEs; `k` is the text of the key."""
    below = _children(tree)

    def least(node: str) -> str:
        if node not in below:
            return node.removeprefix("shard")
        draws = ", ".join(
            f"-ln(('0x' || substr(md5(k || ':{name}'), 1, 13))::BIGINT::DOUBLE "
            f"/ 4503599627370496.0 + {TINY!r}) / {weight!r}"
            for name, weight in below[node]
        )
        cases = " ".join(
            f"WHEN {i} THEN {least(name)}" for i, (name, _) in enumerate(below[node], 1)
        )
        return f"(CASE list_position([{draws}], least({draws})) {cases} END)"

    return least("root")


def op8_sql() -> str:
    """CRC-32 as a fold over the bytes, since SQL has no function for it."""
    tree = even_tree(SHARDS)
    return f"""
WITH RECURSIVE steps(i, step, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE step = 8),
placed AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k, t
  FROM documents, crc_table),
bytes AS (
  SELECT *, hex(encode(text)) AS h FROM placed),
sums AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM bytes),
done AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size, crc AS text_crc32, 'key' AS law,
         {_sql_descend(tree)} AS shard, {_sql_descend(grown(tree, SHARDS))} AS grown_shard
  FROM sums)
SELECT doc_id, size::BIGINT AS size, text_crc32, law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM done
"""

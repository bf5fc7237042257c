"""Merkle manifest of a dataset: one tree of hashes per group, and one over the groups.

Leaves of a group stand in order; every FANOUT consecutive nodes of a level (fewer in the last run)
become one node, the hash of their hexadecimal digests, until one is left: the group's subroot. The
subroots, ordered by group, form the tree of the root in the same way.

Work goes by aligned blocks of FANOUT**2 positions. A block keeps each of its levels as one
string of digests of fixed width: substrings of a run's width are hashed to the parents, and
what stands left and right of a node in its run are the sibling segments of its proof. The nodes above
blocks are a table 256 times smaller, which is handled in the same way, and so on.

Positions need no window over a group: rows are range-partitioned by group and order, numbered within
their partition, and the sizes of earlier ranges are added. A group that holds most rows is thus
split over partitions and blocks like any other; a block has 256 rows at most.

Cases: a null group is a group, before all others; a null key comes first; a null field is `-`, which
no value gives; rows with equal keys are ordered by their leaf, and rows equal in all fields are
leaves of their own in any order; empty and long texts are hashed whole; an empty table gives an empty
result; further columns are carried where asked for, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgepulse.llm.common import stored, table

FANOUT = 16
BLOCK = FANOUT * FANOUT
DIGEST = 64
RUN = FANOUT * DIGEST
"""Characters of a run of digests."""

PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length in front, so that no two lists of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a node leads to by the sibling segments of its path."""
    return F.aggregate(
        path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256)
    )


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    segments = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(segments, ""), 256)


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of (`grp`, ...) with `pos`, gapless from 0 by `order` within `grp`, and `total`."""
    salted = nodes.withColumn("salt", F.rand(7))  # so that a row repeated very often is split
    by = ["grp", *order, "salt"]
    placed = stored(
        salted.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("at", F.monotonically_increasing_id())
        .drop("salt"),
        "merkle-order",
    )
    part = F.shiftright("at", 33)
    groups = Window.partitionBy("grp")
    ranges = (
        placed.groupBy("grp", part.alias("part"))
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("grp").alias("range_grp"),
            "part",
            (F.sum("n").over(groups.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"),
            F.sum("n").over(groups).alias("total"),
        )
    )
    # One row per group and partition; once stored, its size is known where the join is planned.
    ranges = stored(ranges, "merkle-ranges")
    return (
        placed.join(
            ranges, F.col("grp").eqNullSafe(F.col("range_grp")) & (part == F.col("part"))
        )
        .select(*nodes.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")
    )


def _parents(level: str, size: Column) -> Column:
    """The next level of a block as one string: the hash of each run of digests."""
    last = F.floor((size - 1) / FANOUT).cast("int")
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.sha2(F.substring(F.col(level), i * RUN + 1, F.lit(RUN)), 256),
        ),
        "",
    )


def tree(nodes: DataFrame, widest: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of rows (`grp`, `pos`, `total`, `node`, `rest`) with the path above them; the tops.

    `widest` is the largest `total`. The tops are `grp` and `top`, one row for each group.
    """
    blocks = (
        nodes.groupBy("grp", "total", F.floor(F.col("pos") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "node", "rest"))).alias("items"))
        .withColumn("level0", F.array_join("items.node", ""))
        .withColumn("level1", _parents("level0", F.size("items")))
        .withColumn("level2", F.sha2(F.col("level1"), 256))
    )
    blocks = stored(blocks, "merkle-blocks")
    above, top = F.array().cast(PATH), F.lit(None).cast("string")
    if widest > BLOCK:
        tops = blocks.select(
            "grp",
            F.col("block").alias("pos"),
            F.ceil(F.col("total") / BLOCK).alias("total"),
            F.col("level2").alias("node"),
            F.struct(F.lit(0).alias("none")).alias("rest"),
        ).where(F.col("total") > 1)
        upper, _ = tree(tops, -(-widest // BLOCK))
        found = leaves(upper).select(
            F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), "path", "top"
        )
        blocks = blocks.join(
            found,
            F.col("grp").eqNullSafe(F.col("up_grp")) & (F.col("block") == F.col("up_pos")),
            "left",
        )
        above, top = F.coalesce("path", above), F.col("top")
    total = F.col("total")
    blocks = blocks.select(
        "grp", "block", "total", "items", "level0", "level1",
        above.alias("above"),
        F.when(total == 1, F.col("level0"))
        .when(total <= FANOUT, F.col("level1"))
        .when(total <= BLOCK, F.col("level2"))
        .otherwise(top)
        .alias("top"),
    )
    return blocks, blocks.where(F.col("block") == 0).select("grp", "top")


def _segments(run: Column, at: Column) -> Column:
    """What stands left and right of the digest at index `at` of a run."""
    return F.struct(
        F.substring(run, F.lit(1), at * DIGEST).alias("left"),
        F.substring(run, (at + 1) * DIGEST + 1, F.lit(RUN)).alias("right"),
    )


def leaves(blocks: DataFrame) -> DataFrame:
    """The rows of blocks again: `grp`, `pos`, `node`, `rest`, `path` (lowest level first), `top`."""
    none = F.array().cast(PATH)
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("items") - 1) / FANOUT).cast("int")),
        lambda i: F.struct(
            i.alias("run_no"),
            F.slice("items", i * FANOUT + 1, FANOUT).alias("run_items"),
            F.substring("level0", i * RUN + 1, F.lit(RUN)).alias("run"),
            F.when(F.col("total") > FANOUT, F.array(_segments(F.col("level1"), i)))
            .otherwise(none)
            .alias("level1_path"),
        ),
    )
    by_run = blocks.select("grp", "total", "top", "above", F.inline(runs)).select(
        "grp", "total", "top", "run",
        F.concat("level1_path", "above").alias("run_above"),
        F.posexplode("run_items").alias("i", "item"),
    )
    own = F.when(F.col("total") > 1, F.array(_segments(F.col("run"), F.col("i")))).otherwise(none)
    return by_run.select(
        "grp", "item.pos", "item.node", "item.rest", F.concat(own, "run_above").alias("path"), "top"
    )


def manifest(
    rows: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    node: str = "leaf",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rows of (`key`, `group`, `node`, `carry`) with `subroot`, `root` and `path`.

    `path` has, from the leaf's level to the root's, the digests left and right of the node that leads
    to the leaf: `fold(leaf, path)` is the root.
    """
    narrow = stored(
        rows.select(
            F.col(group).alias("grp"),
            F.col(node).alias("node"),
            F.struct(key, *carry).alias("rest"),
        ),
        "merkle-leaves",
    )
    ordered = numbered(narrow.withColumn("own", F.col(f"rest.{key}")), ["own", "node"])
    blocks, subroots = tree(ordered, _widest(ordered))
    groups = stored(
        subroots.select(
            F.lit(0).alias("grp"),
            F.col("top").alias("node"),
            F.struct(F.col("grp").alias("name")).alias("rest"),
        ),
        "merkle-subroots",
    )
    by_name = numbered(groups.withColumn("own", F.col("rest.name")), ["own"])
    roots = leaves(tree(by_name, _widest(by_name))[0]).select(
        F.col("rest.name").alias("of"), F.col("path").alias("root_path"), F.col("top").alias("root")
    )
    roots = stored(roots, "merkle-roots")
    proved = blocks.join(roots, F.col("grp").eqNullSafe(F.col("of"))).withColumn(
        "above", F.concat("above", "root_path")
    )
    root = proved.select("grp", "total", "items", "level0", "level1", "above",
                         F.struct("top", "root").alias("top"))
    done = leaves(root)
    return done.select(
        F.col(f"rest.{key}").alias(key),
        F.col("grp").alias(group),
        F.col("node").alias(node),
        *[F.col(f"rest.{c}").alias(c) for c in carry],
        F.col("top.top").alias("subroot"),
        F.col("top.root").alias("root"),
        "path",
    )


def _widest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("total")).first()[0] or 0


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that a tampered text leads to."""
    documents = table(spark, sf_dir, "documents").select(*FIELDS)
    *others, text = (F.col(c) for c in FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    hashed = documents.select(
        "doc_id",
        "source",
        leaf(*others, text).alias("leaf"),
        F.when(chosen, leaf(*others, F.translate(text, _UPPER, _LOWER))).alias("altered"),
    )
    proved = manifest(hashed, carry=["altered"])
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_sql() -> str:
    """The trees level by level with plain grouping, and each proof climbed step by step."""

    def hashed(text: str) -> str:
        parts = [f"{c}::VARCHAR" for c in FIELDS[:-1]] + [text]
        joined = " || ".join(
            f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts
        )
        return f"sha256({joined})"

    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH RECURSIVE steps(i, step, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE step = 8),
rows_of AS (
  SELECT doc_id, source, {hashed('text')} AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
         THEN {hashed(lowered)} END AS altered
  FROM documents, crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM rows_of),
lower_tree(source, level, pos, node) AS (
  SELECT source, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM lower_tree) WHERE n > 1
  GROUP BY source, level, pos // 16),
tops AS (SELECT source, max(level) AS height FROM lower_tree GROUP BY source),
named AS (
  SELECT t.source, t.height, l.node,
         row_number() OVER (ORDER BY t.source NULLS FIRST) - 1 AS place
  FROM tops t JOIN lower_tree l ON t.source IS NOT DISTINCT FROM l.source AND l.level = t.height),
upper_tree(level, pos, node) AS (
  SELECT 0, place, node FROM named
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_tree) WHERE n > 1
  GROUP BY level, pos // 16),
top AS (SELECT level AS height, node AS root FROM upper_tree ORDER BY level DESC LIMIT 1),
segments AS (
  SELECT n.source, n.level, n.pos,
         coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < n.pos), '') AS l,
         coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > n.pos), '') AS r
  FROM lower_tree n JOIN lower_tree o
  ON n.source IS NOT DISTINCT FROM o.source AND n.level = o.level AND n.pos // 16 = o.pos // 16
  GROUP BY ALL),
upper_segments AS (
  SELECT n.level, n.pos,
         coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < n.pos), '') AS l,
         coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > n.pos), '') AS r
  FROM upper_tree n JOIN upper_tree o ON n.level = o.level AND n.pos // 16 = o.pos // 16
  GROUP BY ALL),
climb(source, leaf_pos, step, height, place, pos, cur, siblings) AS (
  SELECT v.source, v.pos, 0, n.height, n.place, v.pos, coalesce(altered, leaf), ''
  FROM leaves v JOIN named n ON v.source IS NOT DISTINCT FROM n.source
  UNION ALL
  SELECT c.source, leaf_pos, step + 1, c.height, place,
         CASE WHEN step + 1 = c.height THEN place ELSE c.pos // 16 END,
         sha256(coalesce(s.l, u.l) || cur || coalesce(s.r, u.r)),
         siblings || coalesce(s.l, u.l) || coalesce(s.r, u.r)
  FROM (SELECT *, CASE WHEN step < height THEN pos
                       WHEN step = height THEN place ELSE pos END AS here FROM climb) c
  LEFT JOIN segments s ON step < c.height AND s.source IS NOT DISTINCT FROM c.source
       AND s.level = step AND s.pos = here
  LEFT JOIN upper_segments u ON step >= c.height AND u.level = step - c.height AND u.pos = here
  WHERE step < c.height + (SELECT height FROM top)),
ends AS (SELECT * FROM climb WHERE step = height + (SELECT height FROM top))
SELECT doc_id, leaf, node AS subroot, root, sha256(siblings) AS proof_sha256, cur AS folded_root,
       cur = root AS verified
FROM leaves v JOIN ends e ON v.source IS NOT DISTINCT FROM e.source AND v.pos = e.leaf_pos
JOIN named n ON v.source IS NOT DISTINCT FROM n.source, top
"""

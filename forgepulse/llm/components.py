"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is an aggregation (the least neighbour of every node, combined before the shuffle) and a
join; a node with very many neighbours is split by the join's skew handling. The edges of each round are
written to the shared folder, so lineage stays short and a lost executor costs one round at most.
The number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgepulse.llm.common import stored

MAX_ROUNDS = 100


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang every node's larger (or all) neighbours on its least neighbour."""
    if larger:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = around.join(least, "a")
    if larger:
        found = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return found.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list of longs (a, b); the root is the least node.

    Repeated edges and loops do no harm; nodes without an edge to another do not appear.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges, before = stored(edges, "edges"), None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state["n"] == 0 or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = stored(_star(_star(edges, larger=True), larger=False), "edges")
    raise RuntimeError("components did not settle")

"""Connected components of an edge table by alternating star contraction, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsight.llm.storage import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node, and the node, on its least neighbour."""
    near = _both(edges) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = near.join(least, near.u == least.c)
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("c").alias("u"), F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of `edges` (u, v longs) but the roots; the root is the least node.

    Each round is written to the shared folder. Rounds grow with the logarithm of a component's
    size. No edges give no rows; self-loops and repeated edges change nothing; null ends are dropped.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = materialise(edges, "stars"), None
    while True:
        edges = materialise(_star(_star(edges, True), False), "stars")
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if row[0] == 0 or (tuple(row) == seen and row[0] == row[2]):
            return edges.select("u", F.col("v").alias("root"))
        seen = tuple(row)

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import scratch, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b), a > b.

    large: each node's larger neighbours move to its least neighbour; else its smaller
    neighbours and the node itself do.  Only the minimum is gathered for each node.
    """
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        to = F.col("m").alias("b")
        moved = both.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), to), F.struct("a", to))))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) name, as a written table; root is the least node reachable.

    Links may repeat and point either way; a link from a node to itself or to null is dropped.  No links give no rows.
    Each round is written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    with scratch(links.sparkSession) as result:
        edges, seen = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"), None
        for k in range(most_rounds):
            edges = written(_stars(written(_stars(edges, True), f"large{k}"), False), f"stars{k}")  # two small plans: the driver keeps each with all its changes
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                return result(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), "roots")
            seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

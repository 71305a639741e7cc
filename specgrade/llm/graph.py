"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import cut_observed, gathered


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node moves to the least node
    around it.  Small star: so do the node and its smaller neighbours."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    moved = joined.filter(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge; the label is the least node
    of its component.  ``edges`` has long columns a and b.  Alternates large
    and small stars, O(log^2 n) rounds, each cut by a checkpoint."""
    told = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    (now, state), before = cut_observed(edges.filter("a <> b").select("a", "b").distinct(), **told), None
    while state["n"] and state != before:
        before = state
        # an edge moves to one edge, so only a round's last rows need distinct()
        now, state = cut_observed(gathered(_star(_star(now, True), False).distinct(), 2 * state["n"]), **told)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))

"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge; equal label, same component.

    Rounds of contraction: every node joins its smallest neighbour, and edges
    are carried over to the joined nodes.  Node numbers are hashed first, so
    the order is random and the number of edges falls by a steady factor.
    Tables between rounds are written to the shared folder.
    """
    name = lambda c: F.struct(F.xxhash64(c).alias("key"), F.col(c).alias("id"))
    edges = edges.select(name("a").alias("a"), name("b").alias("b")).where("a != b")
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().withColumn("label", F.col("node")), "labels")
    edges = materialize(edges.distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        # One step of pointer jumping shortens chains.
        above = parents.select(F.col("a").alias("up"), F.col("up").alias("top"))
        parents = materialize(parents.join(above, "up").select("a", "top"), "parents")
        to = lambda side: parents.select(F.col("a").alias(side), F.col("top").alias(f"{side}_top"))
        edges = materialize(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b")).where("a != b").distinct(), "edges")
        moved = parents.select(F.col("a").alias("label"), "top")
        labels = materialize(labels.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
    return labels.select(F.col("node.id").alias("node"), F.col("label.id").alias("label"))


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` as ``components`` gives them, after more edges, whose nodes may be new.

    The edges are carried over to the components they join, so the rounds work on those alone.
    """
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    joined = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a != b").distinct()
    joined = materialize(joined, "joins")
    if joined.isEmpty():
        return labels
    tops = components(joined).withColumnsRenamed({"node": "of", "label": "top"})
    known = labels.join(tops, F.col("label") == F.col("of"), "left").select("node", F.coalesce("top", "label").alias("label"))
    new = tops.join(labels, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("top").alias("label"))
    return materialize(known.union(new), "extended")

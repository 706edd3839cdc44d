"""Connected components of a link table, with every step a join or an aggregate by node."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import durable


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of every node (those above it, or itself and those below) on the least of them."""
    ends = _both(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    hung = ends.join(least, "a")
    if larger:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node hangs on one other that hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by_node.where("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Large-star and small-star steps alternate until every component is one star, each round written to the shared folder. A
    node with very many links is a plain key of a join, whose large partitions Spark splits. No links: no rows.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        now = durable(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

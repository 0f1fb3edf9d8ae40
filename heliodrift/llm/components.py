"""Connected components of a table of links, by rounds of joins with each node's least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.tables import stored


def _to_least(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _below_to_least(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    others = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every node with a link.

    Links need not be distinct; null ends and loops are ignored. Each round shortens all
    paths, so rounds grow with the logarithm of the longest path; a node's neighbours are
    never gathered, only their least is.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges, before = stored(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
        edges = stored(_below_to_least(_to_least(edges)))
    children = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return children.unionByName(roots)

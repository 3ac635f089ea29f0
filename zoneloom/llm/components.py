"""Connected components of a link table by alternating large and small stars, every round a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them. Edges point down (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of a link, where ``root`` is the least node of its component.

    Links are rows of two comparable ids; repeated links, links to itself and links with a null change nothing.
    A round is a grouped minimum and a join back to the links, so a node with many links is split by adaptive
    execution; the rounds grow with the logarithm of the longest path. Only two numbers per round reach the driver.
    """
    edges = cut_lineage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
        following = _state(edges)
        if following == state:
            break
        state = following
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select("v", F.col("v").alias("r")).distinct())

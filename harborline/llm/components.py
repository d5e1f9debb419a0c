"""Connected components of a link table by alternating stars, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned


def _toward(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link to another node.

    `links` holds two long columns `a` and `b`; direction, repeats and self-links do not matter and rows with a NULL are
    left out. Output: `node`, `component`, where the component is the smallest node reachable. An empty link table gives
    no rows.

    Each round points every larger neighbour of a node at the node's least neighbour, then every node and its smaller
    neighbours at the least of them. Rounds go on until nothing changes; their number grows with the logarithm of the
    longest chain. A node's neighbours are never gathered: the least one is an aggregate, joined back to the links, and
    both sides of that join are written frames, so that a node with very many links can be split at run time.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    stars = pinned(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pinned(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        wide = pinned(_toward(both.where(F.col("v") > F.col("u")), least).distinct())
        least = pinned(wide.groupBy("u").agg(F.min("v").alias("m")))
        stars = pinned(_toward(wide, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.session import stage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps: each hangs the neighbours of a node below
    the smallest of them, until every component is one star. Minima are stored before they
    are joined back, so adaptive execution can split the edges of a hub. Each step is a
    written table, which cuts the lineage. Null ends and loops are ignored.
    """
    stars = stage(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges",
    )
    seen = _signature(stars)
    while seen[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "minima")
        large = stage(stars.join(low, F.col("v") == F.col("k")).select("u", F.col("m").alias("v")), "large_star")
        low = stage(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "minima")
        moved = large.join(low, F.col("u") == F.col("k")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small_star")
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(stars: DataFrame) -> tuple:
    """Rows and an order-free sum of hashes: equal when a round changed nothing."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(stars.agg(F.count("*"), F.sum(hashed)).first())

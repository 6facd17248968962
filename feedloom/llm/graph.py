"""Connected components of an edge table by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """``u, v, low``: each edge with the smallest of u and all its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return edges.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _lowest(edges)
    return (
        down.select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(down.select("u", F.col("low").alias("v")))
        .where("u > v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node with an edge; the component is its smallest node.

    ``edges`` has two long columns ``u, v``. Each round writes its edges to shared
    storage; the rounds end when a round changes nothing, after O(log n) of them.
    """
    edges = stored(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

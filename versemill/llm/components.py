"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.joins import fits_in_memory
from versemill.staging import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(a, b)`` with ``a > b``.

    Large: neighbours above a node are linked to the least node of its neighbourhood;
    small: a node and its neighbours below are. Only a minimum is taken per node, so a node
    with many links is no burden; the minima are broadcast if they are few, and else the
    join with them is split where it is skewed. Edges may repeat in the result.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.union(edges.select(F.col("b"), F.col("a")))
    least = stage(both.groupBy("node").agg(F.min("other").alias("low")), "star-least")
    minima = F.broadcast(least) if fits_in_memory(least) else least
    joined = both.join(minima, "node").withColumn("low", F.least("node", "low"))
    if large:
        out = joined.where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("other").alias("a"), F.col("low").alias("b")).union(
            least.select(F.col("node"), F.col("low"))
        )
    return out.where("a > b")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; the component is its least node.

    Each step is written; steps end when the edges no longer change, after a number that
    grows with the logarithm of the longest chain. No links give an empty table.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links"
    )
    mark = None
    while True:
        edges = stage(_stars(_stars(edges, large=True), large=False).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )

"""Connected components of a graph stored as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import settle


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and no ``v`` is a ``u``: then each ``v`` is the component of its ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("starts"), F.lit(0).alias("stops")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("starts"), F.lit(1).alias("stops"))
    )
    seen = ends.groupBy("node").agg(F.sum("starts").alias("starts"), F.max("stops").alias("stops"))
    return seen.where("starts > 1 OR (starts = 1 AND stops = 1)").isEmpty()


def _smallest(pairs: DataFrame) -> DataFrame:
    """``u, m``: the smallest of ``u`` and its neighbours. Written, so that its size is known: Spark then broadcasts it
    or splits skewed partitions of the join."""
    return settle(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "smallest")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges(u, v)``: the smallest node that each one reaches.

    Alternates two steps until all edges form stars: every node hands its larger neighbours to its smallest neighbour,
    then every node and its smaller neighbours go to the smallest of these. Edges never multiply, minima are combined
    before the shuffle, and each round is written to the shared folder. Loops and repeated edges do no harm.
    """
    edges = settle(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.where(F.col("v") > F.col("u")).join(_smallest(both), "u")
        large = settle(larger.select(F.col("v").alias("u"), F.col("m").alias("v")), "large_star")
        least = _smallest(large)
        passed = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), "m")
        small = passed.unionByName(least).select("u", F.col("m").alias("v"))
        edges = settle(small.where(F.col("u") != F.col("v")).distinct(), "small_star")
    ends = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)

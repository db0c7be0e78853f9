"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.folders import stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node u, or u itself."""
    return stored(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach, for every node that has a link.

    Links may repeat, point either way or at themselves; those with a null end are ignored. A node with very
    many links is reduced to one row per task before its minimum travels, and its links meet the minimum in a
    join that Spark can split. The number of rounds grows with the logarithm of the longest chain.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(ends.select(*nodes).distinct(), "edges")
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v >= u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        star = large.join(_least(large), "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))

"""Connected components of a graph given as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (u, v: long) and the smallest node that it is linked with.

    Large-star and small-star steps take turns until the edges no longer change; every edge then leads to the smallest
    node of its component. Self-loops, repeated edges and either direction are fine; null ends are ignored.

    A step has aggregates and joins by node only: no neighbourhood is gathered. The smallest neighbours are stored
    before they are joined, so that Spark can split a node with very many edges over tasks.
    """
    e = stored(_oriented(edges), "edges")
    seen = _digest(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(_oriented(both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        old, e = e, stored(_oriented(small.select("v", F.col("m").alias("u")).unionByName(least.select("u", F.col("m").alias("v")))), "small")
        discard(old, nearest, large, least)
        before, seen = seen, _digest(e)
        if before == seen:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

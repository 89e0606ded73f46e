"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that has an edge to another, with the smallest node it is connected to. Stored.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest it knows. Each
    round works on edges in proportion to the graph and is stored; long chains take a number of rounds logarithmic in
    their length. Edges with a null end don't count.
    """
    u, v = F.col("u"), F.col("v")
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v)).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(u, F.min("v")).alias("m"))
        large = both.join(least, "u").where((v > u) & (v != F.col("m"))).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(u.alias("node"), v.alias("component"))
        seen = state

"""Connected components of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import discard, materialized


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). One row for each linked node: node, component (its smallest reachable node).

    Each round hangs the larger neighbours of a node, then the smaller ones, on its least neighbour, until nothing
    changes: a number of rounds that grows with the logarithm of the longest chain. A round has two aggregations with
    partial sums and two equi-joins; its result is written to the shared folder, and only counts reach the driver.
    """
    edges = materialized(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        older, edges = edges, materialized(hung.where("u > v").distinct(), "edges")
        discard(older)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            break
        state = now
    # a node below several others is the root of each; its own row is its component
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))

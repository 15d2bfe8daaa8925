"""Connected components of an edge table by alternating large-star and small-star steps (MapReduce connected
components, Kiveris et al. 2014). Labels and edges stay distributed; each step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both if large else both.where(F.col("v") < F.col("u"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = near.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")) if large else joined.where(F.col("v") != F.col("m"))
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component): the least node of each node's component, for all nodes with an edge
    to another. Nulls and loops are ignored; no edges give no rows."""
    edges = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before = None
    while True:
        # All edges point from a node to a smaller one; when every node has one and no root has any, they are stars.
        last, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        discard(last)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state

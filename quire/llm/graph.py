"""Connected components of links between long node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _arrows(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)``: the smallest node that it is linked with, directly or not.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to the
    smallest node of its neighbourhood, until nothing changes. A round is two sums with map-side
    minima and two joins; the tables are written, so a lost executor costs no round. Self-links
    keep a node without others; nulls are not nodes."""
    edges = stored(links.select("u", "v").dropna().distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges, mark = edges.where("u != v"), None
    while True:
        both = _arrows(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(stars.where("u != v").distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

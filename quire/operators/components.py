"""A3 at scale: single-linkage clusters at a fixed threshold are the connected components of
the graph whose edges are page pairs with distance below the threshold.

Components by alternating large-star / small-star rounds (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014): O(log^2 n) rounds of one aggregate and one join each, keyed by
(input, node), so a hot input is spread over many tasks and long chains of pages do not need a
round per page. Every node ends pointing at the lowest page of its component, which is the
canonical cluster id used everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pairs import band_width, metric_pairs, page_pairs


def _large_star(e: DataFrame) -> DataFrame:
    # e: (input_id, u, v), both directions present. Each node links its larger neighbours to the
    # smallest node of its neighbourhood (itself included).
    m = e.groupBy("input_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        e.where(F.col("v") > F.col("u"))
        .join(m, ["input_id", "u"])
        .select("input_id", F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(e: DataFrame) -> DataFrame:
    # e: directed edges (u -> v); take each as (larger, smaller) and link the smaller side and
    # the node itself to the smallest of them.
    d = e.select("input_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    m = d.groupBy("input_id", "u").agg(F.min("v").alias("m"))
    linked = d.join(m, ["input_id", "u"]).select("input_id", F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return linked.unionByName(m.select("input_id", "u", F.col("m").alias("v")))


def _both_ways(d: DataFrame) -> DataFrame:
    return d.unionByName(d.select("input_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(input_id, page_no, label)``: label = lowest page reachable from the page."""
    e = cut_lineage(_both_ways(edges.select("input_id", F.col("i").alias("u"), F.col("j").alias("v"))))
    while True:
        star = cut_lineage(_small_star(_large_star(e)).distinct())
        nxt = cut_lineage(_both_ways(star))
        if nxt.count() == e.count() and nxt.exceptAll(e).isEmpty():
            e = nxt
            break
        e = nxt
    # after convergence every node is adjacent to its component minimum
    parent = e.groupBy("input_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    return (
        nodes.select("input_id", "page_no")
        .join(parent.select("input_id", F.col("u").alias("page_no"), "label"), ["input_id", "page_no"], "left")
        .select("input_id", "page_no", F.coalesce("label", "page_no").cast("int").alias("label"))
    )


def single_linkage_components(pages: DataFrame, alpha: float, threshold: float, vec: str = "embedding") -> DataFrame:
    """A3 for large inputs: edges are the page pairs with distance strictly below the threshold, pruned by the band of pages
    (exact for 0 <= alpha < 1) or by pivots where there is none; clusters are their connected components."""
    pages = pages.select("input_id", "page_no", vec)
    band = band_width(alpha, threshold)
    if band is None and alpha >= 1:
        edges = metric_pairs(pages, alpha, threshold, vec=vec)
    else:
        edges = page_pairs(pages, alpha, vec=vec, max_gap=band).where(F.col("dist") < F.lit(float(threshold)))
    return connected_components(pages, edges)

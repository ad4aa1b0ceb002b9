"""Distributed agglomerative clustering: one input's work is spread over many tasks.

State is a cluster-pair table ``(input_id, ca, cb, s, c, mx, mn)`` - sum, count, max and min
of the page distances known between clusters ``ca < cb`` - plus cluster sizes and page labels.
Each round:

1. linkage value per cluster pair whose page distances are all known (average s/c, complete mx,
   single mn over whatever is known); keep values below the threshold;
2. every cluster's nearest neighbour = least (value, low id, high id) over its pairs;
3. merge all *mutual* nearest pairs at once (reducible linkages give the same clusters as
   one-at-a-time greedy merging), renaming the higher id to the lower;
4. re-aggregate the pair table under the new ids (a shuffle keyed by the cluster pair, not by
   the input, so a hot input is spread over many tasks) and write it to the cluster's checkpoint
   folder. Inputs without any value below the threshold are final and leave the table.

Rounds go on until no pair merges. Average and complete linkage with a band take the fewer rounds of ``blocks.py`` instead, unless
``cluster_rounds`` is called by name. Pruning, exact for 0 <= alpha < 1 because the blended distance
is at least (1-alpha)*|i-j|:

* single and complete linkage only ever need page pairs closer than threshold/(1-alpha) pages
  and with distance below the threshold (for complete, a missing pair shows as a count below
  size_a*size_b and bars the merge);
* average linkage of two clusters is at least (1-alpha) times the distance of their mean pages, so
  only pairs of clusters whose means are closer than threshold/(1-alpha) can merge. Their
  page distances are summed on demand, when merging brings them into that band.

For alpha >= 1 (or below 0) there is no band, and average linkage starts from all page pairs of an input, in tiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DIST_DECIMALS
from ..functions.vectors import blended_distance
from ..session import cut_lineage
from .pairs import band_width, page_pairs

_KNOWN = ["s", "c", "mx", "mn"]


def _linkage_value(linkage: str):
    whole = F.col("c") == F.col("na") * F.col("nb")
    if linkage == "average":
        return F.when(whole, F.round(F.col("s") / F.col("c"), DIST_DECIMALS))
    if linkage == "complete":
        return F.when(whole, F.col("mx"))
    return F.col("mn")


def _as_clusters(pairs: DataFrame) -> DataFrame:
    d = F.col("dist")
    return pairs.select("input_id", F.col("i").alias("ca"), F.col("j").alias("cb"), d.alias("s"), F.lit(1).cast("long").alias("c"), d.alias("mx"), d.alias("mn"))


def _summed(known: DataFrame) -> DataFrame:
    return known.groupBy("input_id", "ca", "cb").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("mx").alias("mx"), F.min("mn").alias("mn"))


def _renamed(df: DataFrame, merged: DataFrame, c: str) -> DataFrame:
    m = merged.select("input_id", F.col("b").alias(c), F.col("a").alias("_to"))
    return df.join(m, ["input_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")


def _moved(known: DataFrame, merged: DataFrame) -> DataFrame:
    """The pair table under the ids after the merges."""
    both = _renamed(_renamed(known, merged, "ca"), merged, "cb").where(F.col("ca") != F.col("cb"))
    return _summed(both.select("input_id", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), *_KNOWN))


def _in_band(clusters: DataFrame, band: float) -> DataFrame:
    """Pairs ``ca < cb`` of clusters whose mean pages are closer than the band. Means are cut into strips as
    wide as the band, so a cluster meets those of its own strip and of the next one."""
    mean = F.col("pages") / F.col("n")
    c = clusters.select("input_id", "cl", mean.alias("m"), F.floor(mean / band).alias("strip"))
    left = c.select("input_id", F.col("cl").alias("x"), F.col("m").alias("mx_"), "strip", F.explode(F.array(F.col("strip"), F.col("strip") + 1)).alias("meet"))
    right = c.select("input_id", F.col("cl").alias("y"), F.col("m").alias("my_"), F.col("strip").alias("meet"))
    near = left.join(right, ["input_id", "meet"]).where((F.abs(F.col("mx_") - F.col("my_")) < band) & ((F.col("strip") < F.col("meet")) | (F.col("x") < F.col("y"))))
    return near.select("input_id", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))


def _cross_sums(wanted: DataFrame, labels: DataFrame, vectors: DataFrame, alpha: float) -> DataFrame:
    """Sums over all page pairs of the ``wanted(input_id, ca, cb)`` cluster pairs."""
    side = lambda c, p, v: labels.join(vectors, ["input_id", "page_no"]).select("input_id", F.col("cl").alias(c), F.col("page_no").alias(p), F.col("v").alias(v))
    pages = wanted.join(side("ca", "i", "vi"), ["input_id", "ca"]).join(side("cb", "j", "vj"), ["input_id", "cb"])
    low = F.col("i") < F.col("j")  # the same order of arguments for a pair whichever cluster it is in
    first = [F.when(low, F.col(x)).otherwise(F.col(y)) for x, y in (("vi", "vj"), ("vj", "vi"), ("i", "j"), ("j", "i"))]
    dist = blended_distance(*first, alpha, DIST_DECIMALS)
    return _summed(pages.select("input_id", "ca", "cb", dist.alias("s"), F.lit(1).cast("long").alias("c"), dist.alias("mx"), dist.alias("mn")))


def _merge(pages: DataFrame, alpha: float, threshold: float, linkage: str, vec: str, distance: Callable | None = None) -> DataFrame:
    """``labels(input_id, page_no, cl)`` at the threshold. A ``distance`` of the caller's has no known band, so all page pairs of an
    input are taken."""
    pages = pages.select("input_id", "page_no", vec)
    band, demand = None if distance else band_width(alpha, threshold), False
    if linkage == "average" and band is not None:
        demand, vectors = True, pages.select("input_id", "page_no", F.col(vec).alias("v"))
    labels = cut_lineage(pages.select("input_id", "page_no", F.col("page_no").alias("cl")))
    clusters = cut_lineage(labels.select("input_id", "cl", F.lit(1).cast("long").alias("n"), F.col("page_no").cast("long").alias("pages")))
    if demand:
        known = cut_lineage(_cross_sums(_in_band(clusters, band), labels, vectors, alpha))
    else:
        pairs = page_pairs(pages, alpha, vec=vec, max_gap=band, distance=distance)
        known = cut_lineage(_as_clusters(pairs if linkage == "average" else pairs.where(F.col("dist") < float(threshold))))
    while True:
        na = clusters.select("input_id", F.col("cl").alias("ca"), F.col("n").alias("na"))
        nb = clusters.select("input_id", F.col("cl").alias("cb"), F.col("n").alias("nb"))
        valued = known.join(na, ["input_id", "ca"]).join(nb, ["input_id", "cb"]).select("input_id", "ca", "cb", _linkage_value(linkage).alias("v"))
        cand = valued.where(F.col("v") < float(threshold))
        directed = cand.select("input_id", F.explode(F.array("ca", "cb")).alias("x"), F.struct("v", "ca", "cb").alias("p"))
        nearest = directed.groupBy("input_id", "x").agg(F.min("p").alias("p"))
        mutual = nearest.groupBy("input_id", "p").agg(F.count("*").alias("sides")).where(F.col("sides") == 2)
        merged = cut_lineage(mutual.select("input_id", F.col("p.ca").alias("a"), F.col("p.cb").alias("b"), F.col("p.v").alias("height")))
        if merged.isEmpty():
            return labels
        alive = merged.select("input_id").distinct()
        if demand:
            known = known.join(alive, "input_id", "left_semi")
        after = _renamed(clusters, merged, "cl").groupBy("input_id", "cl").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
        after = cut_lineage(after.join(alive, "input_id", "left_semi") if demand else after)
        if demand:
            # the parts of the pairs now in the band, as clusters were before; those not known yet are summed
            part = lambda c: merged.select("input_id", F.col("a").alias(c), F.explode(F.array("a", "b")).alias(f"_{c}"))
            whole = _in_band(after, band).join(part("ca"), ["input_id", "ca"], "left").join(part("cb"), ["input_id", "cb"], "left")
            x, y = F.coalesce("_ca", "ca"), F.coalesce("_cb", "cb")
            parts = whole.select("input_id", F.least(x, y).alias("ca"), F.greatest(x, y).alias("cb"))
            missing = cut_lineage(parts.join(known, ["input_id", "ca", "cb"], "left_anti"))
            if not missing.isEmpty():
                known = known.unionByName(_cross_sums(missing, labels, vectors, alpha))
        known = _moved(known, merged)
        if demand:  # what is known in part only is of no use; it is summed anew should the pair come into the band
            size = lambda c: after.select("input_id", F.col("cl").alias(c), F.col("n").alias(f"n_{c}"))
            known = known.join(size("ca"), ["input_id", "ca"]).join(size("cb"), ["input_id", "cb"]).where(F.col("c") == F.col("n_ca") * F.col("n_cb")).drop("n_ca", "n_cb")
        known = cut_lineage(known)
        clusters = after
        labels = cut_lineage(_renamed(labels, merged, "cl"))


def cluster_rounds(pages: DataFrame, alpha: float, threshold: float, linkage: str, vec: str = "embedding", distance: Callable | None = None) -> DataFrame:
    """``(input_id, page_no, label)`` by mutual-nearest-neighbour rounds."""
    labels = _merge(pages, alpha, threshold, linkage, vec, distance)
    return labels.select("input_id", "page_no", F.col("cl").cast("int").alias("label"))

"""Clusters of many settings (alpha, linkage) at many thresholds.

A merge tree serves all thresholds, and a page's labels over them are a few intervals: ``(label, first, last)`` counts thresholds in ascending order, so no row
is made per page, setting and threshold. Inputs of at most ``block`` pages are done by the first round's tasks, which hold all of an input's pages:
one matrix of content distances for all settings. What is longer is cut over tasks, each linkage in its way: average and complete
linkage in blocks of pages where a band bounds them (``blocks.py``), from rows of distances where none does (``rowstore.py``), single linkage by its
spanning forest (``forest.py``). Both give the same clusters, and tests compare them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import BLOCK, block_merges, block_pages, plain_id, with_settings
from .forest import forest_spans
from .rowstore import store_merges, sure_inputs

Settings = dict[int, tuple[float, str]]


def by_length(pages: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The pages of inputs that one block holds, and those of longer ones (None if there are none)."""
    long = cut_lineage(pages.where(F.col("page_no") >= (block or BLOCK)).select("input_id").distinct())
    if long.isEmpty():
        return pages, None
    return pages.join(long, "input_id", "left_anti"), pages.join(long, "input_id", "left_semi")


def below(height: Column, thresholds: list[float]) -> Column:
    """The number of thresholds up to a height: a merge holds at the thresholds from that place on."""
    return sum((F.when(height >= F.lit(t), 1).otherwise(0) for t in thresholds), F.lit(0)).cast("int")


def merge_spans(pages: DataFrame, merges: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(input_id, page_no, label, first, last)`` from merges ``(input_id, a, b, height)``. Heights never fall along a page's way up, which is
    followed by doubling; intervals of one page are joined with those of its label where they overlap."""
    last = len(thresholds) - 1
    up = merges.select("input_id", F.col("b").alias("page_no"), F.col("a").cast("int").alias("_a"), below(F.col("height"), thresholds).alias("_from"))
    own = pages.select("input_id", "page_no").join(up, ["input_id", "page_no"], "left")
    start = F.coalesce("_from", F.lit(last + 1))
    parts = F.array(F.struct(F.col("page_no").cast("int").alias("label"), F.lit(0).alias("first"), (start - 1).alias("last")), F.struct(F.col("_a").alias("label"), start.alias("first"), F.lit(last).alias("last")))
    spans = cut_lineage(own.select("input_id", "page_no", F.inline(parts)).where(F.col("first") <= F.col("last")))
    while True:
        step = spans.select("input_id", F.col("page_no").alias("label"), F.col("label").alias("_next"), F.col("first").alias("_first"), F.col("last").alias("_last"))
        met = spans.join(step, ["input_id", "label"]).where((F.col("_first") <= F.col("last")) & (F.col("first") <= F.col("_last")))
        new = met.select("input_id", "page_no", F.col("_next").alias("label"), F.greatest("first", "_first").alias("first"), F.least("last", "_last").alias("last"), (F.col("label") != F.col("_next")).alias("_moved"))
        new = cut_lineage(new)
        spans = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return spans


def long_spans(pages: DataFrame, settings: Settings, thresholds: list[float], vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``(input_id, page_no, label, first, last)`` of inputs of any length, input ids ``"<setting>:<input_id>"``. A label is a page of the cluster at all
    thresholds of its interval, the same for all its pages."""
    top, parts, merges = thresholds[-1], [], []
    pages = cut_lineage(pages.select("input_id", "page_no", vec))
    single = {k: s for k, s in settings.items() if s[1] == "single"}
    near = {k: s for k, s in settings.items() if k not in single and block_pages(s[0], top)}
    far = {k: s for k, s in settings.items() if k not in single and k not in near}
    if single:
        found, _ = forest_spans(pages, {str(k): a for k, (a, _) in single.items()}, top, vec, block)
        placed = found.select("input_id", "page_no", "label", below(F.col("low"), thresholds).alias("first"), (below(F.col("high"), thresholds) - 1).alias("last"))
        parts.append(placed.where(F.col("first") <= F.col("last")))
    if near:
        merges.append(block_merges(pages, near, top, vec))
    joined = {k: s for k, s in far.items() if s[0] > 1.0 and s[1] == "average"}
    stored = {k: s for k, s in far.items() if k not in joined}
    paged = [(pages, near | stored)] if near or stored else []
    if joined:
        sure = cut_lineage(sure_inputs(pages, [a for a, _ in joined.values()], thresholds[0], vec))
        one = with_settings(pages.join(sure, "input_id"), joined, "low")
        parts.append(one.select("input_id", "page_no", F.col("v").alias("label"), F.lit(0).alias("first"), F.lit(len(thresholds) - 1).alias("last")))
        others = cut_lineage(pages.join(sure, "input_id", "left_anti"))
        if not others.isEmpty():
            merges.append(store_merges(others, joined, top, vec, block))
            paged.append((others, joined))
    if stored:
        merges.append(store_merges(pages, stored, top, vec, block))
    if merges:
        own = reduce(DataFrame.unionByName, [with_settings(p, s, vec) for p, s in paged])
        parts.append(merge_spans(own, cut_lineage(reduce(DataFrame.unionByName, merges)), thresholds))
    return reduce(DataFrame.unionByName, parts)


def setting_column(settings: Settings, field: str, values: list) -> Column:
    """``values`` by the setting before an input id."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.substring_index("input_id", ":", 1).cast("int") + 1).alias(field)


def long_labels(pages: DataFrame, alpha: float, linkage: str, thresholds: list[float], vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``(input_id, threshold, page_no, label)``, labels the lowest pages of clusters."""
    ordered = sorted(thresholds)
    spans = long_spans(pages, {0: (float(alpha), linkage)}, ordered, vec, block)
    each = spans.select(plain_id(), F.col("page_no").cast("int").alias("page_no"), F.col("label").cast("int").alias("label"), F.explode(F.sequence("first", "last")).alias("_k"))
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in ordered]), F.col("_k") + 1).alias("threshold")
    if linkage != "single":  # a merge keeps the name of the lower cluster, so the labels are lowest pages already
        return each.select("input_id", threshold, "page_no", "label")
    each = cut_lineage(each.withColumnRenamed("label", "_name"))
    lowest = each.groupBy("input_id", "_k", "_name").agg(F.min("page_no").alias("label"))
    return each.join(lowest, ["input_id", "_k", "_name"]).select("input_id", threshold, "page_no", "label")


def long_contingency(pages: DataFrame, gold: DataFrame, settings: Settings, thresholds: list[float], vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``(input_id, alpha, linkage, threshold, gold, label, n)``: pages are counted per interval, then the counts are spread over its thresholds."""
    return span_cells(long_spans(pages, settings, thresholds, vec, block), gold, settings, thresholds)


def span_cells(spans: DataFrame, gold: DataFrame, settings: Settings, thresholds: list[float]) -> DataFrame:
    """``long_contingency`` of the intervals that ``long_spans`` gives."""
    alphas, linkages = ([s[i] for s in settings.values()] for i in (0, 1))
    own = spans.select("input_id", "page_no", "label", "first", "last").withColumn("_plain", plain_id())
    marked = own.join(gold.select(F.col("input_id").alias("_plain"), "page_no", "gold"), ["_plain", "page_no"])
    counted = marked.groupBy("input_id", "label", "gold", "first", "last").agg(F.count("*").alias("n"), F.min("page_no").alias("_low"))
    each = counted.select("input_id", "label", "gold", "n", "_low", F.explode(F.sequence("first", "last")).alias("_k"))
    cells = cut_lineage(each.groupBy("input_id", "_k", "label", "gold").agg(F.sum("n").alias("n"), F.min("_low").alias("_low")))
    lowest = cells.groupBy("input_id", "_k", "label").agg(F.min("_low").cast("int").alias("_label"))
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("_k") + 1).alias("threshold")
    cells = cells.join(lowest, ["input_id", "_k", "label"])
    return cells.select(plain_id(), setting_column(settings, "alpha", [float(a) for a in alphas]), setting_column(settings, "linkage", linkages), threshold, F.col("gold").cast("int").alias("gold"), F.col("_label").alias("label"), "n")

"""Agglomerative clustering of inputs of any size in blocks of pages, for average and complete linkage with 0 <= alpha < 1.

Two clusters whose mean pages are ``threshold / (1 - alpha)`` pages apart or more (the band) never merge, and a cluster has
no more pages than a few bands. So an input is cut into blocks of ``BLOCK`` pages by the clusters' mean pages.
A task gets a block's clusters (its core) and those within the band around it, and does all merges of core clusters that don't
depend on clusters outside (``merge.settle``). What waits at a border is merged in the next round,
whose blocks are shifted by half a block. A round's settled clusters never merge again, so only those that wait take part in the next one.
It ends when two rounds in a row, one of each kind, merge nothing, or one does and none waits; inputs within one
block are done after the first. A task holds the matrix of one block whatever the size of the input.

Several settings ``(alpha, linkage)`` are worked on together, as inputs ``"<setting>:<input_id>"``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIST_DECIMALS
from ..session import cut_lineage
from .merge import blended_matrix, settle
from .pairs import band_width

BLOCK, LARGEST_BLOCK = 1024, 4096
STATE = "input_id string, page_no int, cl int, mean double, into int, height double, waits boolean"


def block_pages(alpha: float, threshold: float) -> int | None:
    """Pages of a block, at least four bands; None if there is no band, or it is too wide for one task."""
    band = band_width(alpha, threshold)
    if band is None or band <= 0 or 4 * (band + 1) > LARGEST_BLOCK:
        return None
    return max(BLOCK, math.ceil(4 * (band + 1)))


def with_settings(pages: DataFrame, settings: dict[int, tuple[float, str]], vec: str) -> DataFrame:
    """``input_id, page_no, v``: the pages once for each setting."""
    each = F.explode(F.array(*[F.lit(str(k)) for k in settings])).alias("_setting")
    return pages.select("input_id", "page_no", F.col(vec).alias("v"), each).select(F.concat_ws(":", "_setting", "input_id").alias("input_id"), F.col("page_no").cast("int").alias("page_no"), "v")


def _block_fn(settings: dict[int, tuple[float, str]], threshold: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        alpha, linkage = settings[int(pdf["input_id"].iloc[0].split(":", 1)[0])]
        pdf = pdf.sort_values(["cl", "page_no"], ignore_index=True)
        pages = pdf["page_no"].to_numpy(dtype=np.int64)
        d = blended_matrix(np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]]), pages, alpha, DIST_DECIMALS)
        ids, starts, size = np.unique(pdf["cl"].to_numpy(dtype=np.int64), return_index=True, return_counts=True)
        if len(ids) < len(pages):
            reduce = np.add.reduceat if linkage == "average" else np.maximum.reduceat
            d = reduce(reduce(d, starts, axis=0), starts, axis=1)
            if linkage == "average":
                d = d / np.outer(size, size)
        core = pdf["core"].to_numpy(dtype=bool)[starts]
        sums = pdf["mean"].to_numpy()[starts] * size
        count, root = size.astype(np.float64), np.arange(len(ids))
        into, height = {}, {}
        merges, settled = settle(d, size, core, linkage, DIST_DECIMALS, threshold)
        for a, b, h in merges:
            root[root == b] = a
            sums[a] += sums[b]
            count[a] += count[b]
            into[int(ids[b])], height[int(ids[b])] = int(ids[a]), h
        own = root[np.searchsorted(ids, pdf["cl"].to_numpy(dtype=np.int64))]
        out = pd.DataFrame({"input_id": pdf["input_id"], "page_no": pages, "cl": ids[own], "mean": sums[own] / count[own], "into": pdf["into"], "height": pdf["height"]})
        # the row of the page that names a cluster notes where the cluster went
        first = pdf["page_no"].map(into)
        out["height"] = out["height"].where(first.isna(), pdf["page_no"].map(height)).astype("float64")
        out["into"] = out["into"].where(first.isna(), first).astype("Int64")
        out["waits"] = ~settled[own]
        return out[pdf["core"].to_numpy(dtype=bool)]

    return fn


def block_states(pages: DataFrame, settings: dict[int, tuple[float, str]], threshold: float, block: int | None = None) -> DataFrame:
    """``STATE`` of every page of ``pages(input_id, page_no, v)`` as of ``with_settings``: its cluster ``cl``; and where the page names a
    cluster that merged into another, ``into`` and ``height``."""
    threshold = float(threshold)
    block = block or max(block_pages(a, threshold) for a, _ in settings.values())
    band = max(band_width(a, threshold) for a, _ in settings.values()) + 1  # one page for the rounding of distances
    page = F.col("page_no")
    none = [F.lit(None).cast("int").alias("into"), F.lit(None).cast("double").alias("height")]
    rows = pages.select("input_id", "page_no", "v", page.alias("cl"), page.cast("double").alias("mean"), *none)
    done, shift, idle, merged_before, vectors = [], 0.0, 0, 0, None
    while True:
        at = lambda x: F.floor((x + shift) / block)  # noqa: E731, B023
        m = F.col("mean")
        spread = rows.select("*", at(m).alias("_own"), F.explode(F.array_distinct(F.array(at(m - band), at(m), at(m + band)))).alias("_block"))
        work = spread.where(F.col("_block") >= 0).withColumn("core", F.col("_own") == F.col("_block")).drop("_own")
        state = cut_lineage(work.groupBy("input_id", "_block").applyInPandas(_block_fn(settings, threshold), STATE))
        into, waits = F.col("into").isNotNull(), F.col("waits")
        merged, waiting, merged_waiting = state.agg(F.count_if(into), F.count_if(waits), F.count_if(into & waits)).first()
        idle = idle + 1 if merged == merged_before else 0
        merged_before = merged_waiting
        if idle == 2 or (waiting == 0 and (idle or vectors is None)):
            return reduce(DataFrame.unionByName, done, state).drop("waits")
        done.append(state.where(~waits))
        state = state.where(waits).drop("waits")
        if vectors is None:  # what waits later also waits after the first round
            vectors = cut_lineage(pages.join(cut_lineage(state.select("input_id", "page_no")), ["input_id", "page_no"], "left_semi"))
        shift = 0.0 if shift else block / 2
        rows = state.join(vectors, ["input_id", "page_no"])


def plain_id() -> Column:
    """The input id without its setting."""
    return F.expr("substring(input_id, instr(input_id, ':') + 1)").alias("input_id")


def block_labels(pages: DataFrame, alpha: float, threshold: float, linkage: str, vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``(input_id, page_no, label)`` at one threshold."""
    settings = {0: (float(alpha), linkage)}
    return block_states(with_settings(pages, settings, vec), settings, threshold, block).select(plain_id(), "page_no", F.col("cl").alias("label"))


def block_merges(pages: DataFrame, settings: dict[int, tuple[float, str]], threshold: float, vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``(input_id, a, b, height)`` of every setting, input ids as of ``with_settings``."""
    state = block_states(with_settings(pages, settings, vec), settings, threshold, block)
    return state.where(F.col("into").isNotNull()).select("input_id", F.col("into").alias("a"), F.col("page_no").alias("b"), "height")

"""A1-A4 agglomerative clustering of pages with the blended distance.

Two physical paths with one result (labels = lowest page of each cluster). The caller names the path
with ``spread``; nothing switches by an input's size:

* ``spread=True`` (default) - inputs of any size. Average and complete linkage merge in blocks of pages (``blocks.py``).
  Single linkage takes connected components of the below-threshold edges
  (``components.py``), which needs O(log^2 n) rounds however long the page chains are. Settings without a band of pages
  (alpha >= 1) merge over rows of distances (``rowstore.py``), distances of the caller's over a cluster-pair table (``rounds.py``).
* ``spread=False``, for inputs known to be small - ``groupBy(input_id).applyInPandas``: a task builds an input's matrix with numpy
  and merges greedily. It holds 8 n^2 bytes for n pages. A ``matrix`` of the caller's is of a whole input, so it takes this path.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_ALPHA, DEFAULT_LINKAGE, DEFAULT_THRESHOLD, DIST_DECIMALS, LINKAGES
from .merge import blended_matrix, greedy_merges, labels_at

LABEL_SCHEMA = "input_id string, threshold double, page_no int, label int"


def _check_linkage(linkage: str) -> None:
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage: {linkage}")


def _group_arrays(pdf: pd.DataFrame, vec: str):
    pdf = pdf.sort_values("page_no")
    pages = pdf["page_no"].to_numpy(dtype=np.int64)
    x = np.array([np.asarray(v, dtype=np.float64) for v in pdf[vec]]) if len(pdf) else np.zeros((0, 0))
    return pdf["input_id"].iloc[0] if len(pdf) else None, pages, x


def _labels_fn(alpha: float, thresholds: list[float], linkage: str, vec: str, matrix: Callable | None = None):
    top = max(thresholds)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        input_id, pages, x = _group_arrays(pdf, vec)
        n = len(pages)
        if n == 0:
            return pd.DataFrame({"input_id": [], "threshold": [], "page_no": [], "label": []})
        merges = greedy_merges(matrix(x, pages) if matrix else blended_matrix(x, pages, alpha, DIST_DECIMALS), linkage, DIST_DECIMALS, stop=top)
        frames = []
        for t in thresholds:
            roots = labels_at(n, merges, t)
            frames.append(
                pd.DataFrame({"input_id": input_id, "threshold": float(t), "page_no": pages.astype(np.int32), "label": pages[roots].astype(np.int32)})
            )
        return pd.concat(frames, ignore_index=True)

    return fn


def cluster_grouped(
    pages: DataFrame,
    alpha: float = DEFAULT_ALPHA,
    thresholds: list[float] | float = DEFAULT_THRESHOLD,
    linkage: str = DEFAULT_LINKAGE,
    vec: str = "embedding",
    matrix: Callable | None = None,
) -> DataFrame:
    """Labels for each threshold via one numpy task per input."""
    _check_linkage(linkage)
    ts = [float(thresholds)] if isinstance(thresholds, (int, float)) else [float(t) for t in thresholds]
    return (
        pages.select("input_id", "page_no", vec)
        .groupBy("input_id")
        .applyInPandas(_labels_fn(float(alpha), ts, linkage, vec, matrix), LABEL_SCHEMA)
    )


def cluster_pages(
    pages: DataFrame,
    alpha: float = DEFAULT_ALPHA,
    threshold: float = DEFAULT_THRESHOLD,
    linkage: str = DEFAULT_LINKAGE,
    vec: str = "embedding",
    spread: bool = True,
    matrix: Callable | None = None,
    distance: Callable | None = None,
) -> DataFrame:
    """A1/A2/A3: ``(input_id, page_no, label)`` at one threshold. ``spread``: cut each input's work over many tasks.

    Another distance than the blended one: ``matrix(vectors, pages)``, the n x n distances of an input in numpy, or, with
    ``spread``, ``distance(vector_i, vector_j, i, j)``, a column from column names."""
    from .blocks import block_labels, block_pages
    from .components import single_linkage_components
    from .rounds import cluster_rounds

    _check_linkage(linkage)
    if not spread or (matrix is not None and distance is None):
        return cluster_grouped(pages, alpha, [threshold], linkage, vec, matrix).drop("threshold")
    if linkage == "single" and distance is None:
        return single_linkage_components(pages, alpha, threshold, vec)
    if distance is None and block_pages(alpha, threshold):
        return block_labels(pages, alpha, threshold, linkage, vec)
    if distance is None:
        return threshold_sweep(pages, alpha, [threshold], linkage, vec).drop("threshold")
    return cluster_rounds(pages, alpha, threshold, linkage, vec, distance)


def threshold_sweep(
    pages: DataFrame,
    alpha: float,
    thresholds: list[float],
    linkage: str = DEFAULT_LINKAGE,
    vec: str = "embedding",
    spread: bool = True,
    block: int | None = None,
) -> DataFrame:
    """A4: labels of every input at many thresholds, from one merge tree per input. With ``spread`` inputs longer than ``block`` pages are cut over
    tasks (``sweep.py``)."""
    _check_linkage(linkage)
    if not spread:
        return cluster_grouped(pages, alpha, thresholds, linkage, vec)
    from .sweep import by_length, long_labels

    short, long = by_length(pages.select("input_id", "page_no", vec), block)
    labels = cluster_grouped(short, alpha, thresholds, linkage, vec)
    return labels if long is None else labels.unionByName(long_labels(long, alpha, linkage, thresholds, vec, block))

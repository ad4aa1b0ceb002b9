"""Page-pair operators: J1 (all pairs of an input, ``pdist``), J2 (full matrix, ``squareform``),
A13 (block-averaged distance heatmap).

Pairs are produced by a *tiled* self-join: pages are cut into blocks of ``block`` pages and each
(block_i <= block_j) tile of an input is its own join key. An input of n pages becomes
(n/block)^2 / 2 independent tasks instead of one n^2 task, so a hot input cannot pin one
executor. When a page band is known (alpha < 1 with a threshold), tiles wholly outside the band
are never generated, which turns the O(n^2) pairing into O(n * band).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import blended_distance, l2_distance

DEFAULT_BLOCK = 256


def band_width(alpha: float, threshold: float) -> float | None:
    """Pages apart beyond which ``alpha*l2 + (1-alpha)*|i-j| >= threshold`` always holds.

    Exact for 0 <= alpha < 1 (the content term is never negative); None means no bound.
    """
    if alpha is None or threshold is None or not (0.0 <= alpha < 1.0):
        return None
    return threshold / (1.0 - alpha)


def page_pairs(
    pages: DataFrame,
    alpha: float,
    vec: str = "embedding",
    max_gap: float | None = None,
    block: int = DEFAULT_BLOCK,
    decimals: int | None = 9,
    distance: Callable[[str, str, str, str], Column] | None = None,
) -> DataFrame:
    """``(input_id, i, j, dist)`` for every page pair ``i < j`` of an input.

    ``max_gap``: keep only pairs with ``j - i < max_gap`` (the band); None keeps all pairs.
    ``distance``: another distance than the blended one, from the names of the two vector and the two page columns.
    """
    p = pages.select("input_id", "page_no", vec).withColumn("_blk", F.floor(F.col("page_no") / block).cast("int"))
    nblk = p.groupBy("input_id").agg(F.max("_blk").alias("_last"))
    if max_gap is None:
        reach = None
    else:
        # furthest block a page's partners can live in
        reach = int(math.ceil(max_gap / block)) + 1
    # left page i goes to tiles (blk_i, bj) for bj >= blk_i; right page j to tiles (bi, blk_j) for bi <= blk_j
    hi = F.col("_last") if reach is None else F.least(F.col("_last"), F.col("_blk") + reach)
    lo = F.lit(0) if reach is None else F.greatest(F.lit(0), F.col("_blk") - reach)
    left = (
        p.join(nblk, "input_id")
        .select(
            "input_id",
            F.col("page_no").alias("i"),
            F.col(vec).alias("_vi"),
            F.col("_blk").alias("_bi"),
            F.explode(F.sequence(F.col("_blk"), hi)).alias("_bj"),
        )
    )
    right = p.select(
        "input_id",
        F.col("page_no").alias("j"),
        F.col(vec).alias("_vj"),
        F.col("_blk").alias("_bj"),
        F.explode(F.sequence(lo, F.col("_blk"))).alias("_bi"),
    )
    cond = F.col("i") < F.col("j")
    if max_gap is not None:
        cond = cond & ((F.col("j") - F.col("i")) < F.lit(float(max_gap)))
    joined = left.join(right, ["input_id", "_bi", "_bj"]).where(cond)
    return joined.select(
        "input_id",
        "i",
        "j",
        (distance("_vi", "_vj", "i", "j") if distance else blended_distance("_vi", "_vj", "i", "j", alpha, decimals)).alias("dist"),
    )


PIVOTS = 4
SALTS = 64
TILE = 4096  # pages of a block that is measured as a matrix
STRIP = 512  # rows of a pair of blocks that are compared at once
_SLACK = 1e-8  # distances are rounded, and their bounds are sums of doubles


def pivot_blocks(pages: DataFrame, vec: str = "embedding", pivots: int = PIVOTS, block: int = DEFAULT_BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(input_id, page_no, v, away, blk)`` and the columns to ``keep``: each page's content distances to a few pivot pages of its input, and its block. Pages
    are ordered by their nearest pivot and the distance to it, and cut into blocks of ``block`` pages, so a block's pages are near each other and
    none is larger than another, however many vectors are equal. Stored."""
    from ..session import cut_lineage
    from .numbering import number_rows

    p = cut_lineage(pages.select("input_id", "page_no", F.col(vec).alias("v"), *keep))
    rank = F.row_number().over(Window.partitionBy("input_id").orderBy(F.xxhash64("page_no"), "page_no"))
    chosen = p.withColumn("_rank", rank).where(F.col("_rank") <= pivots)
    points = chosen.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "v"))), lambda s: s["v"]).alias("_points"))
    spread = points.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a long input meets its points in many tasks
    far = p.withColumn("_salt", F.pmod(F.hash("page_no"), F.lit(SALTS))).join(spread, ["input_id", "_salt"]).select("input_id", "page_no", "v", *keep, F.transform("_points", lambda q: l2_distance(q, "v")).alias("away"))
    placed = far.withColumn("_d", F.array_min("away")).withColumn("_near", F.array_position("away", F.col("_d")))
    ordered = number_rows(placed, "input_id", ["_near", "_d", "page_no"], out="_place")
    return ordered.select("input_id", "page_no", "v", *keep, "away", F.floor(F.col("_place") / block).cast("int").alias("blk"))


def metric_tiles(blocks: DataFrame, alpha: float, threshold: float) -> DataFrame:
    """``(input_id, a, b)``: the pairs ``a <= b`` of ``pivot_blocks`` that may hold a pair of pages below the threshold. By the triangle
    inequality two pages are at least as far apart as their distances to any pivot differ; what page numbers can take off (alpha > 1) is
    bounded by the blocks' page ranges. Blocks meet as a row each, not their pages."""
    span = blocks.select("input_id", "blk", "page_no", F.posexplode("away").alias("_p", "_d")).groupBy("input_id", "blk", "_p").agg(
        F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.min("page_no").alias("first"), F.max("page_no").alias("last")
    )
    rows = span.groupBy("input_id", "blk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "lo", "hi"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("spans"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    left = rows.select("input_id", F.col("blk").alias("a"), F.col("spans").alias("_sa"), F.col("first").alias("_fa"), F.col("last").alias("_la"))
    right = rows.select("input_id", F.col("blk").alias("b"), F.col("spans").alias("_sb"), F.col("first").alias("_fb"), F.col("last").alias("_lb"))
    apart = F.array_max(F.zip_with("_sa", "_sb", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0))))
    most = F.greatest(F.col("_lb") - F.col("_fa"), F.col("_la") - F.col("_fb"))  # pages apart at most
    least = F.greatest(F.col("_fb") - F.col("_la"), F.col("_fa") - F.col("_lb"), F.lit(0))
    gap = (most if alpha > 1.0 else least).cast("double")
    bound = F.lit(float(alpha)) * apart + F.lit(1.0 - float(alpha)) * gap
    return left.join(right, "input_id").where((F.col("a") <= F.col("b")) & (bound < F.lit(float(threshold) + _SLACK))).select("input_id", "a", "b")


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's pages as one row: their numbers and vectors as bytes."""
    pages, v = pdf["page_no"].to_numpy(np.int64), np.array(pdf["v"].tolist(), np.float64)
    return pd.DataFrame({"input_id": [key[0]], "blk": [key[1]], "pages": [pages.tobytes()], "vectors": [np.ascontiguousarray(v).tobytes()]})


def near_cells(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, alpha: float, threshold: float, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, columns, content distances)`` of the pairs of ``x`` (pages ``p``) and ``y`` (pages ``q``) whose blended distance may lie below the threshold: chosen by one
    matrix product with room for its rounding, then measured by direct differences."""
    gap = np.zeros((1, 1)) if alpha == 1.0 else np.abs(p[:, None] - q[None, :]).astype(np.float64)
    rest = threshold - (1.0 - alpha) * gap + _SLACK  # what the content distance may weigh
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    weighed = alpha * alpha * (size - 2 * (x @ y.T))
    r, c = np.nonzero((rest >= 0) & (weighed < rest * rest + 1e-8 * (1 + rest * rest + alpha * alpha * size)))
    l2 = np.empty(len(r))
    for k in range(0, len(r), chunk):
        diff = x[r[k : k + chunk]] - y[c[k : k + chunk]]
        l2[k : k + chunk] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return r, c, l2


def _near_fn(alpha: float, threshold: float):
    """Per pair of blocks: a row for each page of the first that has any near ones in the second, with their numbers and content distances."""

    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        input_id, a, b = key
        sides = {}
        for row in pdf.itertuples(index=False):
            pages = np.frombuffer(row.pages, np.int64)
            sides[row.blk] = pages, np.frombuffer(row.vectors, np.float64).reshape(len(pages), -1)
        (p, x), (q, y) = sides[a], sides[b]
        first, others, far = [], [], []
        for s in range(0, len(p), STRIP):
            r, c, l2 = near_cells(x[s : s + STRIP], y, p[s : s + STRIP], q, alpha, threshold)
            r += s
            if a == b:
                once = p[r] < q[c]
                r, c, l2 = r[once], c[once], l2[once]
            at = np.flatnonzero(np.diff(r, prepend=-1))  # rows come in order
            first += p[r[at]].tolist()
            others += np.split(q[c], at[1:]) if len(at) else []
            far += np.split(l2, at[1:]) if len(at) else []
        return pd.DataFrame({"input_id": input_id, "p": pd.array(first, dtype="int64"), "q": pd.Series(others, dtype=object), "l2": pd.Series(far, dtype=object)})

    return fn


def metric_pairs(pages: DataFrame, alpha: float, threshold: float, vec: str = "embedding", decimals: int | None = 9, pivots: int = PIVOTS, block: int = TILE) -> DataFrame:
    """J1 below a threshold, for any ``alpha >= 0``: ``(input_id, i, j, dist)`` of the page pairs ``i < j`` with ``dist < threshold``. For alpha >= 1, where no band of
    pages bounds a pair, tiles are left out by the pages' distances to pivots (``metric_tiles``); no pair below the threshold is lost. Blocks travel packed as one row
    and a task measures one pair of blocks as a matrix, in strips; only near pairs become rows."""
    from ..session import cut_lineage

    if not alpha >= 0:
        raise ValueError(f"alpha must not be negative: {alpha}")
    alpha, threshold, number = float(alpha), float(threshold), pages.schema["page_no"].dataType
    blocks = cut_lineage(pivot_blocks(pages.where(F.col(vec).isNotNull() & F.col("page_no").isNotNull()), vec, pivots, block))
    both = F.array(F.struct(F.col("a").alias("blk"), "a", "b"), F.struct(F.col("b").alias("blk"), "a", "b"))
    of = metric_tiles(blocks, alpha, threshold).select("input_id", F.inline(F.array_distinct(both)))
    packed = blocks.groupBy("input_id", "blk").applyInPandas(_pack, "input_id string, blk int, pages binary, vectors binary")
    near = packed.join(of, ["input_id", "blk"]).groupBy("input_id", "a", "b").applyInPandas(_near_fn(alpha, threshold), "input_id string, p long, q array<long>, l2 array<double>")
    each = near.select("input_id", F.col("p").alias("_p"), F.inline(F.arrays_zip("q", "l2")).alias("_q", "_l2"))
    dist = F.lit(alpha) * F.col("_l2") + F.lit(1.0 - alpha) * F.abs(F.col("_p") - F.col("_q")).cast("double")
    dist = F.round(dist, decimals) if decimals is not None else dist
    found = each.select("input_id", F.least("_p", "_q").cast(number).alias("i"), F.greatest("_p", "_q").cast(number).alias("j"), dist.alias("dist"))
    return found.where(F.col("dist") < F.lit(threshold))


def distance_matrix(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Full symmetric matrix from one pass over the upper triangle plus a zero diagonal."""
    both = pairs.select("input_id", F.inline(F.array(F.struct("i", "j", "dist"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))))
    diag = pages.select("input_id", F.col("page_no").alias("i"), F.col("page_no").alias("j"), F.lit(0.0).alias("dist"))
    return both.unionByName(diag)


def weighted_matrices(pages: DataFrame, alphas, vec: str = "embedding") -> DataFrame:
    """J2 at several alphas from one pass over the page pairs: ``(input_id, alpha, i, j, dist)``. A pair's content
    distance is computed once."""
    whole = distance_matrix(page_pairs(pages, 1.0, vec=vec, decimals=None), pages)
    gap = F.abs(F.col("i") - F.col("j")).cast("double")
    weighted = [F.struct(F.lit(float(a)).alias("alpha"), (F.col("dist") * F.lit(float(a)) + gap * F.lit(1.0 - float(a))).alias("dist")) for a in alphas]
    return whole.select("input_id", "i", "j", F.inline(F.array(*weighted)))


def distance_heatmap(matrix: DataFrame, cell: int = 10, keys: tuple[str, ...] = ("input_id",)) -> DataFrame:
    """The matrix averaged over ``cell`` x ``cell`` page blocks (for viewing large inputs)."""
    return matrix.groupBy(
        *keys,
        (F.floor(F.col("i") / cell)).cast("int").alias("bi"),
        (F.floor(F.col("j") / cell)).cast("int").alias("bj"),
    ).agg(
        F.avg("dist").alias("avg_dist"),
        F.min("dist").alias("min_dist"),
        F.max("dist").alias("max_dist"),
        F.count(F.lit(1)).cast("bigint").alias("cells"),
    )

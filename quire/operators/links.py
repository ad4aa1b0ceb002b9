"""J1 below a threshold without a row per pair: which pages are copies of which, and how many pages each is close to.

Equal vectors of an input form a class, named by its lowest page; only one vector of a class is compared, so a group of copies costs what one
page costs. Classes are ordered and cut into even blocks by their distances to a few pivots, and block pairs that the triangle inequality rules out are
never made (``pairs.pivot_blocks``, ``pairs.metric_tiles``). A task measures one pair of blocks as a matrix and returns a count per class,
never its pairs, so neither copies nor dense groups of near copies make rows that grow with the square of their size. The counts are exact.

Pages without a vector are a class of their own without links; a zero vector is a vector like any other. With a threshold of 0 or less
nothing is linked. An empty table gives an empty result. Repeated (input, page) rows count as pages of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DIST_DECIMALS
from ..session import cut_lineage
from .pairs import PIVOTS, STRIP, TILE, metric_tiles, pivot_blocks

SALTS = 16  # a class's pages meet it in so many tasks
COUNTS = "input_id string, page_no int, n long"


def copy_classes(pages: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(input_id, _h, _g, page_no, size, v)``: the distinct vectors of each input under a 128-bit hash, with their lowest page and number of
    pages. Counted in the tasks before the shuffle."""
    p = pages.where(F.col(vec).isNotNull()).select("input_id", "page_no", F.col(vec).alias("v"))
    hashed = p.select("input_id", *_hash("v"), "page_no", "v")
    return hashed.groupBy("input_id", "_h", "_g").agg(F.min("page_no").alias("page_no"), F.count(F.lit(1)).alias("size"), F.any_value("v").alias("v"))


def _hash(vec: str) -> list:
    return [F.xxhash64(vec).alias("_h"), F.xxhash64(F.lit(1), vec).alias("_g")]


def near_matrix(x: np.ndarray, y: np.ndarray, threshold: float, chunk: int = 1 << 14) -> np.ndarray:
    """Which rows of ``x`` and ``y`` are nearer than ``threshold``: by one matrix product, and where its rounding could decide, by direct differences."""
    near = np.zeros((len(x), len(y)), bool)
    if threshold <= 0:
        return near
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    over = size - 2 * (x @ y.T) - threshold * threshold
    slack = 1e-8 * (1 + threshold * threshold + size)
    near = over < -slack
    r, c = np.nonzero(np.abs(over) <= slack)
    for k in range(0, len(r), chunk):
        i, j = r[k : k + chunk], c[k : k + chunk]
        diff = x[i] - y[j]
        near[i, j] = np.round(np.sqrt(np.einsum("ij,ij->i", diff, diff)), DIST_DECIMALS) < threshold
    return near


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's classes as one row: pages, sizes and vectors as bytes."""
    pages, size, v = (np.ascontiguousarray(x).tobytes() for x in (pdf["page_no"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), np.array(pdf["v"].tolist(), np.float64)))
    return pd.DataFrame({"input_id": [key[0]], "blk": [key[1]], "pages": [pages], "sizes": [size], "vectors": [v]})


def _count_fn(threshold: float):
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        input_id, a, b = key
        sides = {}
        for row in pdf.itertuples(index=False):
            pages = np.frombuffer(row.pages, np.int64)
            sides[row.blk] = pages, np.frombuffer(row.sizes, np.int64), np.frombuffer(row.vectors, np.float64).reshape(len(pages), -1)
        (pages_a, size_a, v_a), (pages_b, size_b, v_b) = sides[a], sides[b]
        n_a, n_b = np.zeros(len(pages_a), np.int64), np.zeros(len(pages_b), np.int64)
        for s in range(0, len(pages_a), STRIP):
            part = slice(s, s + STRIP)
            near = near_matrix(v_a[part], v_b, threshold)
            if a == b:
                near[np.arange(len(near)), s + np.arange(len(near))] = False
            n_a[part] = near @ size_b
            n_b += size_a[part] @ near
        page, n = (pages_a, n_a) if a == b else (np.concatenate((pages_a, pages_b)), np.concatenate((n_a, n_b)))
        return pd.DataFrame({"input_id": input_id, "page_no": page[n > 0], "n": n[n > 0]})

    return fn


def class_links(classes: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = TILE) -> DataFrame:
    """``(input_id, page_no, n)``: for each class that has any, the pages of other classes whose vectors lie nearer than ``threshold``."""
    blocks = cut_lineage(pivot_blocks(classes, "v", pivots, block, keep=("size",)))
    both = F.array(F.struct(F.col("a").alias("blk"), "a", "b"), F.struct(F.col("b").alias("blk"), "a", "b"))
    of = metric_tiles(blocks, 1.0, threshold).select("input_id", F.inline(F.array_distinct(both)))
    packed = blocks.groupBy("input_id", "blk").applyInPandas(_pack, "input_id string, blk int, pages binary, sizes binary, vectors binary")
    met = packed.join(of, ["input_id", "blk"])
    return met.groupBy("input_id", "a", "b").applyInPandas(_count_fn(float(threshold)), COUNTS).groupBy("input_id", "page_no").agg(F.sum("n").alias("n"))


def near_links(pages: DataFrame, threshold: float, vec: str = "embedding", pivots: int = PIVOTS, block: int = TILE) -> DataFrame:
    """``(input_id, page_no, class_page, n_links)`` of every page: the lowest page of its input with the same vector, and how many other pages
    of its input lie nearer than ``threshold`` (content distance, alpha 1), copies included."""
    pages = cut_lineage(pages.select("input_id", "page_no", F.col(vec).alias("v")))
    classes = cut_lineage(copy_classes(pages, "v"))
    found = class_links(classes, threshold, pivots, block)
    own = F.col("size") - 1 if threshold > 0 else F.lit(0)
    linked = classes.join(found, ["input_id", "page_no"], "left").select("input_id", "_h", "_g", F.col("page_no").alias("class_page"), (F.coalesce("n", F.lit(0)) + own).cast("long").alias("n_links"))
    spread = linked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.where("v IS NOT NULL").select("input_id", "page_no", *_hash("v"), F.pmod(F.hash("page_no"), F.lit(SALTS)).alias("_salt"))
    out = salted.join(spread, ["input_id", "_h", "_g", "_salt"]).select("input_id", "page_no", "class_page", "n_links")
    return out.unionByName(pages.where("v IS NULL").select("input_id", "page_no", F.col("page_no").alias("class_page"), F.lit(0).cast("long").alias("n_links")))

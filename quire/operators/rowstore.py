"""Average and complete linkage where no band of pages bounds what can merge (alpha >= 1): one row per cluster, of its distances to all others.

A row is a binary value of doubles, in order of the clusters' lowest pages. It is put together from tiles of page blocks, so no task measures a whole
input. In a round each row finds its nearest cluster on its own, least by (distance, low page, high page); clusters that are each
other's nearest merge, all such pairs at once; the row of the higher one goes to the lower one's, and every row combines its columns by Lance and
Williams' rule. What moves in a round is one row per merge, and a list of the merges and sizes per input, which is no longer than a row. A task holds a
few rows whatever the size of the input; the store holds 8 n^2 bytes of an input and setting, which is the
size of the problem where any two pages may merge. It is written anew each round, over the store before the last one.

Average linkage with alpha > 1 needs no store for inputs that are longer than ``sure_inputs`` says: distant pages attract, so all their pages end in one cluster.

Both orders of a pair get the same value to the last bit (the lower cluster's parts are combined first), so the two clusters agree
on being nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DIST_DECIMALS
from ..functions.vectors import norm
from ..session import cut_lineage, cut_lineage_by_turns
from .merge import l2_block

TILE = 1024
ROW = "input_id string, pos int, n long, row binary"


def _tile_fn(alphas: list[float], block: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second, input_id = int(pdf["_bi"].iloc[0]), int(pdf["_bj"].iloc[0]), pdf["input_id"].iloc[0]
        pdf = pdf.sort_values("page_no")
        pages = pdf["page_no"].to_numpy(dtype=np.int64)
        x = np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
        low, high = np.flatnonzero(pages // block == first), np.flatnonzero(pages // block == second)
        l2 = l2_block(x[low], x[high])
        gap = np.abs(pages[low][:, None] - pages[high][None, :]).astype(np.float64)
        out = []
        for alpha in alphas:
            d = np.round(alpha * l2 + (1.0 - alpha) * gap, DIST_DECIMALS)
            if first == second:
                np.fill_diagonal(d, np.inf)
            out += [(input_id, alpha, int(p), second, d[k].tobytes()) for k, p in enumerate(pages[low])]
            if first != second:
                out += [(input_id, alpha, int(p), first, np.ascontiguousarray(d[:, k]).tobytes()) for k, p in enumerate(pages[high])]
        return pd.DataFrame(out, columns=["input_id", "alpha", "page_no", "part", "row"])

    return fn


def _first_rows(pages: DataFrame, settings: dict[int, tuple[float, str]], vec: str, block: int, cut: Callable) -> tuple[DataFrame, DataFrame]:
    """The rows of single pages, and ``(input_id, pos, cl)``, the page at each place."""
    p = pages.select("input_id", F.col("page_no").cast("int").alias("page_no"), F.col(vec).alias("v"), F.floor(F.col("page_no") / block).cast("int").alias("_blk"))
    blocks = p.groupBy("input_id").agg(F.sort_array(F.collect_set("_blk")).alias("_all"))
    tiles = F.transform("_all", lambda o: F.struct(F.least(F.col("_blk"), o).alias("_bi"), F.greatest(F.col("_blk"), o).alias("_bj")))
    spread = p.join(blocks, "input_id").select("input_id", "page_no", "v", F.inline(tiles))
    alphas = sorted({a for a, _ in settings.values()})
    parts = spread.groupBy("input_id", "_bi", "_bj").applyInPandas(_tile_fn(alphas, block), "input_id string, alpha double, page_no int, part int, row binary")
    whole = parts.groupBy("input_id", "alpha", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "row"))), lambda s: s["row"]).alias("parts"))
    of = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(a).alias("a")) for k, (a, _) in settings.items()]))
    whole = cut(whole)
    ids = whole.select("input_id", "page_no").distinct().groupBy("input_id").agg(F.array_sort(F.collect_list("page_no")).alias("ids"))
    placed = ids.select("input_id", F.posexplode("ids").alias("pos", "page_no"))
    named = whole.join(placed, ["input_id", "page_no"]).withColumn("_s", of).where(F.col("_s.a") == F.col("alpha"))
    key = F.concat_ws(":", F.col("_s.k"), "input_id").alias("input_id")
    joined = named.select(key, "pos", F.lit(1).cast("long").alias("n"), "parts", F.col("page_no").alias("cl"))

    def join_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["row"] = [b"".join(p) for p in f["parts"]]
            yield f[["input_id", "pos", "n", "row"]]

    return cut(joined.mapInPandas(join_parts, ROW)), cut_lineage(joined.select("input_id", "pos", "cl"))


def _nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for key, pos, row in zip(f["input_id"], f["pos"], f["row"]):
            d = np.round(np.frombuffer(row), DIST_DECIMALS)
            at = int(d.argmin())  # the first of equal ones: the least (low, high) pair of this cluster
            out.append((key, min(pos, at), max(pos, at), float(d[at])))
        yield pd.DataFrame(out, columns=["input_id", "lo", "hi", "v"])


def combine(x, y, nx, ny, complete: bool):
    return np.maximum(x, y) if complete else (nx * x + ny * y) / (nx + ny)


def merged_row(row: np.ndarray, other: np.ndarray | None, pos: int, n: int, n_other: int, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray, complete: bool) -> np.ndarray:
    """The row of cluster ``pos`` after the merges ``lo, hi``; ``other`` is the row that merges into it."""

    def columns(r):
        r = r.copy()
        r[lo] = combine(r[lo], r[hi], sizes[lo], sizes[hi], complete)
        return r

    if other is None:
        out = columns(row)
    else:  # of the columns below, parts are combined first, as their own rows do
        out = columns(combine(row, other, n, n_other, complete))
        out[:pos] = combine(columns(row), columns(other), n, n_other, complete)[:pos]
    out[pos] = np.inf
    return np.delete(out, hi)


def _moved(complete: dict[str, bool]):
    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                lo, hi, sizes = np.asarray(r.lo, np.int64), np.asarray(r.hi, np.int64), np.asarray(r.sizes, np.float64)
                other = None if r.row_b is None else np.frombuffer(r.row_b)
                n_b = 0 if other is None else int(r.n_b)
                row = merged_row(np.frombuffer(r.row), other, r.pos, r.n, n_b, lo, hi, sizes, complete[r.input_id.split(":", 1)[0]])
                out.append((r.input_id, int(r.pos - np.searchsorted(np.sort(hi), r.pos)), int(r.n + n_b), row.tobytes()))
            yield pd.DataFrame(out, columns=["input_id", "pos", "n", "row"])

    return fn


def sure_inputs(pages: DataFrame, alphas: list[float], threshold: float, vec: str = "embedding") -> DataFrame:
    """``(input_id, low)``, the lowest page, of the inputs whose pages are one cluster of average linkage at the threshold for each of the alphas (> 1).

    Two clusters that are left have a linkage of at least t. No content distance is above L, twice the longest vector, so their mean page gap is
    at most w = (alpha L - t) / (alpha - 1). A page has a mean gap of at least (k + 2) / 4 to k others, so no cluster has more than 4 w - 2 pages. The gaps
    of the pages outside one cluster to its mean page average to at most w too, so these are at most 4 w + 1. An input of more than 8 w pages has no two clusters left."""
    known = pages.select("input_id", "page_no", norm(F.col(vec).cast("array<double>")).alias("_norm")).groupBy("input_id").agg(
        F.count("*").alias("n"), F.count_distinct("page_no").alias("places"), F.count("_norm").alias("vectors"), F.min("page_no").cast("int").alias("low"), F.max("_norm").alias("_norm")
    )
    gap = F.greatest(*[(a * 2.0 * F.col("_norm") - threshold + 1e-6) / (a - 1.0) for a in [*alphas, alphas[0]]])
    return known.where((F.col("n") == F.col("places")) & (F.col("n") == F.col("vectors")) & (F.col("n") > 8.0 * gap + 1.0)).select("input_id", "low")


def store_merges(pages: DataFrame, settings: dict[int, tuple[float, str]], threshold: float, vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``(input_id, a, b, height)``: the merges of cluster b into a below the threshold, input ids ``"<setting>:<input_id>"``."""
    cut = cut_lineage_by_turns(pages.sparkSession)
    rows, names = _first_rows(pages, settings, vec, block or TILE, cut)
    complete = {str(k): linkage == "complete" for k, (_, linkage) in settings.items()}
    found = []
    while True:
        near = rows.mapInPandas(_nearest, "input_id string, lo int, hi int, v double")
        mutual = near.where(F.col("v") < float(threshold)).groupBy("input_id", "lo", "hi").agg(F.min("v").alias("v"), F.count("*").alias("sides")).where(F.col("sides") == 2)
        merges = cut_lineage(mutual.drop("sides"))
        if merges.isEmpty():
            break
        of = lambda c, p: names.select("input_id", F.col("pos").alias(p), F.col("cl").alias(c))
        found.append(cut_lineage(merges.join(of("a", "lo"), ["input_id", "lo"]).join(of("b", "hi"), ["input_id", "hi"]).select("input_id", "a", "b", F.col("v").alias("height"))))
        lists = merges.groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("m"))
        sizes = rows.select("input_id", "pos", "n").groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda s: s["n"]).alias("sizes"))
        plan = cut_lineage(lists.join(sizes, "input_id").select("input_id", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), "sizes"))
        gone = merges.select("input_id", F.col("hi").alias("pos"), F.col("lo").alias("_to"))
        sent = rows.join(gone, ["input_id", "pos"]).select("input_id", F.col("_to").alias("pos"), F.col("row").alias("row_b"), F.col("n").alias("n_b"))
        kept = rows.join(gone, ["input_id", "pos"], "left_anti").join(sent, ["input_id", "pos"], "left").join(plan, "input_id")
        rows = cut(kept.mapInPandas(_moved(complete), ROW))
        shift = F.size(F.filter("hi", lambda h: h < F.col("pos")))
        names = cut_lineage(names.join(gone, ["input_id", "pos"], "left_anti").join(plan, "input_id").select("input_id", (F.col("pos") - shift).alias("pos"), "cl"))
    out = pages.sparkSession.createDataFrame([], "input_id string, a int, b int, height double")
    for f in found:
        out = out.unionByName(f)
    return out

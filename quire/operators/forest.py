"""Single linkage's whole merge tree, for inputs of any size and several alphas together, from a minimum spanning forest.

* Tiles. An input's pages are cut into blocks; a task gets a pair of blocks, measures their page pairs once, and keeps for each alpha the
  minimum spanning forest of the pairs below the threshold, at most one edge per page of the tile: an edge that closes a
  circle of lesser ones joins nothing new. Tiles outside an alpha's band of pages are never made.
* Boruvka rounds over what the tiles kept. Every component takes its least outgoing edge, which says when it first joins another one;
  components along such edges become one. A round at least halves the components, so there are at most log2(pages) of them, however
  long the chains of pages are. Edges compare by (distance, low page, high page), so none tie.

A component's least outgoing edge is no longer than that of any other path out, so a page's cluster at a threshold is read off its way up:
it is named by the component's root page as long as the least edge is not below the threshold, and by that of the component it joined from there on.
``forest_spans`` gives these names as intervals of thresholds, a few rows per page whatever the number of thresholds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DIST_DECIMALS
from ..session import cut_lineage
from .merge import l2_block
from .pairs import band_width

TILE = 1024
EDGES = "input_id string, a int, b int, w double, i int, j int"


def spanning_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The places of the minimum spanning forest's edges among the edges ``u, v`` of ``n`` nodes, which come in ascending order."""
    component, left, kept = np.arange(n), np.arange(len(u)), [np.zeros(0, np.int64)]
    while True:
        a, b = component[u[left]], component[v[left]]
        out = a != b
        left, a, b = left[out], a[out], b[out]
        if not len(left):
            return np.unique(np.concatenate(kept))
        least = np.full(n, -1)
        least[np.stack((a, b), 1).ravel()[::-1]] = np.repeat(left, 2)[::-1]  # the last assignment holds: the least edge
        own = np.flatnonzero(least >= 0)
        edge = least[own]
        kept.append(edge)
        parent = np.arange(n)
        parent[own] = np.where(component[u[edge]] == own, component[v[edge]], component[u[edge]])
        mutual = own[(parent[parent[own]] == own) & (own < parent[own])]
        parent[mutual] = mutual
        while (parent[parent] != parent).any():
            parent = parent[parent]
        component = parent[component]


def single_merges(d: np.ndarray, top: float) -> list[tuple[int, int, float, int]]:
    """Single linkage's merges ``(a, b, height, size)`` below ``top`` of one matrix: its spanning forest's edges in order, with the clusters' lowest
    places as names."""
    i, j = np.nonzero(np.triu(d < top, 1))
    order = np.lexsort((j, i, d[i, j]))
    i, j = i[order], j[order]
    kept = spanning_forest(len(d), i, j)
    i, j = i[kept], j[kept]
    return united(len(d), i, j, d[i, j])


def united(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges ``(a, b, height, size)`` along the edges of a forest, in the order given."""
    parent, size, out = list(range(n)), [1] * n, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u_, v_, h in zip(u.tolist(), v.tolist(), w.tolist()):
        a, b = sorted((root(u_), root(v_)))
        parent[b] = a
        size[a] += size[b]
        out.append((a, b, h, size[a]))
    return out


def _tile_fn(settings: dict[str, float], top: float, block: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second, input_id = int(pdf["_bi"].iloc[0]), int(pdf["_bj"].iloc[0]), pdf["input_id"].iloc[0]
        pdf = pdf.sort_values("page_no")
        pages = pdf["page_no"].to_numpy(dtype=np.int64)
        x = np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
        low = np.flatnonzero(pages // block == first)
        high = np.flatnonzero(pages // block == second)
        frames = [pd.DataFrame({"input_id": [], "a": [], "b": [], "w": [], "i": [], "j": []})]
        if len(low) and len(high):
            l2 = l2_block(x[low], x[high])
            gap = np.abs(pages[low][:, None] - pages[high][None, :]).astype(np.float64)
            upper = pages[low][:, None] < pages[high][None, :]
            for name, alpha in settings.items():
                d = np.round(alpha * l2 + (1.0 - alpha) * gap, DIST_DECIMALS)
                r, c = np.nonzero(upper & (d < top))
                w, u, v = d[r, c], low[r], high[c]
                order = np.lexsort((v, u, w))
                w, u, v = w[order], u[order], v[order]
                kept = spanning_forest(len(pages), u, v)
                i, j = pages[u[kept]], pages[v[kept]]
                frames.append(pd.DataFrame({"input_id": f"{name}:{input_id}", "a": i, "b": j, "w": w[kept], "i": i, "j": j}))
        return pd.concat(frames, ignore_index=True)

    return fn


def tile_forests(pages: DataFrame, alphas: dict[str, float], threshold: float, vec: str = "embedding", block: int | None = None) -> DataFrame:
    """``EDGES`` of the tiles' forests, with input ids ``"<name>:<input_id>"`` for each named alpha."""
    block, top = block or TILE, float(threshold)
    p = pages.select("input_id", "page_no", F.col(vec).alias("v"), F.floor(F.col("page_no") / block).cast("int").alias("_blk"))
    last = p.groupBy("input_id").agg(F.max("_blk").alias("_last"))
    bands = [band_width(a, top) for a in alphas.values()]
    reach = F.col("_last") if None in bands else F.least(F.col("_last"), F.col("_blk") + math.ceil(max(bands) / block))
    back = F.lit(0) if None in bands else F.greatest(F.lit(0), F.col("_blk") - math.ceil(max(bands) / block))
    tiles = F.concat(
        F.transform(F.sequence(F.col("_blk"), reach), lambda o: F.struct(F.col("_blk").alias("_bi"), o.alias("_bj"))),
        F.transform(F.filter(F.sequence(back, F.col("_blk")), lambda o: o < F.col("_blk")), lambda o: F.struct(o.alias("_bi"), F.col("_blk").alias("_bj"))),
    )
    spread = p.join(last, "input_id").select("input_id", "page_no", "v", F.inline(tiles))
    return spread.groupBy("input_id", "_bi", "_bj").applyInPandas(_tile_fn(alphas, top, block), EDGES)


def forest_spans(pages: DataFrame, alphas: dict[str, float], threshold: float, vec: str = "embedding", block: int | None = None) -> tuple[DataFrame, int]:
    """``(input_id, page_no, label, low, high)``: the page's cluster is ``label`` (a page of it) at thresholds over ``low`` and up to ``high``, for thresholds up
    to ``threshold``; input ids as of ``tile_forests``. And the number of Boruvka rounds."""
    edges = cut_lineage(tile_forests(pages, alphas, threshold, vec, block))
    name = F.explode(F.array(*[F.lit(k) for k in alphas])).alias("_name")
    state = pages.select("page_no", "input_id", name).select(F.concat_ws(":", "_name", "input_id").alias("input_id"), "page_no", F.col("page_no").alias("label"), F.lit(float("-inf")).alias("low"))
    state, spans, rounds = cut_lineage(state), [], 0
    while True:
        ways = F.inline(F.array(F.struct(F.col("a").alias("x"), F.struct("w", "i", "j", F.col("b").alias("y")).alias("e")), F.struct(F.col("b").alias("x"), F.struct("w", "i", "j", F.col("a").alias("y")).alias("e"))))
        hooks = cut_lineage(edges.select("input_id", ways).groupBy("input_id", "x").agg(F.min("e").alias("e")).select("input_id", "x", F.col("e.y").alias("y"), F.col("e.w").alias("w")))
        if hooks.isEmpty():
            break
        rounds += 1
        other = hooks.select("input_id", F.col("x").alias("y"), F.col("y").alias("_back"))
        root = (F.col("_back") == F.col("x")) & (F.col("x") < F.col("y"))
        up = cut_lineage(hooks.join(other, ["input_id", "y"]).select("input_id", "x", F.when(root, F.col("x")).otherwise(F.col("y")).alias("to"), "w"))
        while True:  # to the root of every chain of hooks, by doubling
            step = up.select("input_id", F.col("x").alias("to"), F.col("to").alias("_next"))
            far = cut_lineage(up.join(step, ["input_id", "to"]).select("input_id", "x", F.col("_next").alias("to"), "w", (F.col("to") != F.col("_next")).alias("_moved")))
            up = far.drop("_moved")
            if far.where("_moved").isEmpty():
                break
        joined = up.where(F.col("x") != F.col("to"))
        seen = cut_lineage(state.join(joined.withColumnRenamed("x", "label"), ["input_id", "label"], "left").select("input_id", "page_no", "label", "low", "to", "w"))
        spans.append(seen.where(F.col("w") > F.col("low")).select("input_id", "page_no", "label", "low", F.col("w").alias("high")))
        state = seen.select("input_id", "page_no", F.coalesce("to", "label").alias("label"), F.greatest("low", F.coalesce("w", "low")).alias("low"))
        for c in ("a", "b"):
            edges = edges.join(up.select("input_id", F.col("x").alias(c), F.col("to").alias(f"_{c}")), ["input_id", c]).drop(c).withColumnRenamed(f"_{c}", c)
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        least = edges.where(F.col("a") != F.col("b")).groupBy("input_id", low, high).agg(F.min(F.struct("w", "i", "j")).alias("e"))
        edges = cut_lineage(least.select("input_id", "a", "b", "e.w", "e.i", "e.j"))
    out = state.select("input_id", "page_no", "label", "low", F.lit(float("inf")).alias("high"))
    for s in spans:
        out = out.unionByName(s)
    return out, rounds

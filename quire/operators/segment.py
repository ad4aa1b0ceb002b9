"""W1 boundary detection and W2 gap split.

W1 is a left fold over an input's pages in page order: a new segment starts when the cosine
of the page to the running mean of the current segment is below ``1 - threshold``; the mean
restarts at that page. The cosine to the mean equals the cosine to the running sum, so only
the sum is carried.

Two paths with one result, named by the caller:
* fold - Catalyst ``aggregate`` over the input's (page, vector) list, which is one value.
* chunked - for inputs of any size: pages are cut into chunks of bounded size, and every chunk is scanned in parallel, first from a
  fresh start. What a chunk needs from those before it is the sum of the open segment's pages, which is known once the page where
  that segment began is known. All chunks take the latest boundary that their predecessors have found so far for it; sums of whole
  stretches of chunks come from a prefix sum over chunk totals, so a segment that runs through a thousand chunks is one guess like any other.
  Chunks whose segment begins elsewhere than thought are scanned again, until they meet a boundary the fresh scan
  also has. It ends when no chunk's beginning changes. See ``boundary_chunked``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_BOUNDARY_THRESHOLD
from ..functions.vectors import cosine_similarity, vector_add
from ..session import cut_lineage

CHUNK_PAGES = 1024
STRIP_PAGES = 4096


def _threshold(threshold: float | None) -> float:
    # None means the default; 0 is a valid threshold (no "falsy" test)
    return DEFAULT_BOUNDARY_THRESHOLD if threshold is None else float(threshold)


def boundary_fold(pages: DataFrame, threshold: float | None = None, vec: str = "embedding") -> DataFrame:
    """``(input_id, page_no, label)`` with labels 0, 1, ... in page order (fold path)."""
    cut = F.lit(1.0 - _threshold(threshold))
    per_input = pages.groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no"), F.col(vec).alias("v")))).alias("ps"))
    first = F.col("ps")[0]
    init = F.struct(first["v"].alias("s"), F.lit(0).alias("label"), F.array(F.lit(0)).alias("labels"))

    def step(acc, p):
        new_seg = cosine_similarity(p["v"], acc["s"]) < cut
        return F.struct(
            F.when(new_seg, p["v"]).otherwise(vector_add(acc["s"], p["v"])).alias("s"),
            (acc["label"] + F.when(new_seg, 1).otherwise(0)).alias("label"),
            F.array_append(acc["labels"], acc["label"] + F.when(new_seg, 1).otherwise(0)).alias("labels"),
        )

    labels = F.aggregate(F.slice("ps", 2, 1 << 30), init, step)["labels"]
    both = F.arrays_zip(F.transform("ps", lambda p: p["page_no"]).alias("page_no"), labels.alias("label"))
    folded = per_input.select("input_id", F.explode(both).alias("z"))
    return folded.select("input_id", F.col("z.page_no").alias("page_no"), F.col("z.label").cast("int").alias("label"))


# ---------------------------------------------------------------- chunked path (large inputs)
LEAST_STRETCH, LARGEST_STRETCH = 16, 256  # pages looked at together


def _scan(x: np.ndarray, cut: float, s0: np.ndarray | None, fresh: np.ndarray | None = None) -> np.ndarray:
    """Boundary flags of a chunk. ``s0``: the sum of the open segment's pages before it, None for a start at its first page. ``fresh``: the flags of
    the scan without ``s0``; from a boundary that both have on, they are equal.

    Stretches of pages are taken together: sums up to each page as if none were a boundary, and the first that is one ends the stretch."""
    n = len(x)
    flags = np.zeros(n, dtype=bool)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    s, at, size = s0, 0, LEAST_STRETCH
    if s is None and n:
        s, flags[0], at = x[0], True, 1
    while at < n:
        part = x[at : at + size]
        sums = np.cumsum(np.concatenate((s[None, :], part)), axis=0)  # row k: the sum before page at + k
        scale = np.sqrt(np.einsum("ij,ij->i", sums[:-1], sums[:-1])) * norm[at : at + size]
        dots = np.einsum("ij,ij->i", part, sums[:-1])
        below = np.divide(dots, scale, out=np.zeros(len(part)), where=scale > 0) < cut
        if not below.any():
            s, at, size = sums[-1], at + len(part), min(LARGEST_STRETCH, size * 2)
            continue
        k = at + int(below.argmax())
        flags[k] = True
        if fresh is not None and fresh[k]:
            flags[k:] = fresh[k:]
            break
        s, at, size = x[k], k + 1, LEAST_STRETCH
    return flags


_CHUNK = "input_id string, chunk int, pages array<int>, flags array<boolean>, began int, tail array<double>, start int"


def _chunk_row(pdf: pd.DataFrame, cut: float, s0, fresh, start) -> pd.DataFrame:
    """A chunk's flags, the page of its last boundary (``began``; null: none), the sum of its pages from there on, and the ``start`` it was scanned for.
    The first page of an input is a boundary; that of another chunk is one only if the segment before it ends there."""
    chunk = int(pdf["chunk"].iloc[0])
    x = np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
    flags = _scan(x, cut, s0, fresh)
    real = flags.copy()
    if s0 is None and chunk:
        real[0] = False
    last = int(np.flatnonzero(real)[-1]) if real.any() else 0
    pages = pdf["page_no"].tolist()
    out = pd.DataFrame({"input_id": [pdf["input_id"].iloc[0]], "chunk": [chunk], "pages": [pages], "flags": [flags.tolist()], "tail": [x[last:].sum(0).tolist()]})
    out["began"] = pd.array([pages[last] if real.any() else None], dtype="Int32")
    out["start"] = pd.array([start], dtype="Int32")
    return out[["input_id", "chunk", "pages", "flags", "began", "tail", "start"]]


def boundary_chunked(pages: DataFrame, threshold: float | None = None, vec: str = "embedding", chunk: int = CHUNK_PAGES, rounds: list | None = None) -> DataFrame:
    """Exact W1 for inputs of any size with bounded work per task (see module doc). ``rounds``: a list that gets the number of chunks
    scanned in each round after the first."""
    cut = 1.0 - _threshold(threshold)
    p = pages.select("input_id", "page_no", F.col(vec).alias("v"), F.floor(F.col("page_no") / chunk).cast("int").alias("chunk"))
    p = cut_lineage(p)
    key = ["input_id", "chunk"]
    fresh = p.groupBy(*key).applyInPandas(lambda pdf: _chunk_row(pdf.sort_values("page_no"), cut, None, None, None), _CHUNK)
    fresh = cut_lineage(fresh)
    # chunks without a page have no row, so an input's first chunk may have any number
    firsts = fresh.groupBy("input_id").agg(F.min("chunk").alias("_first"))
    cur = fresh

    def again(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        s0 = np.asarray(state["s_in"].iloc[0], dtype=np.float64)
        return _chunk_row(pdf.sort_values("page_no"), cut, s0, np.asarray(state["flags"].iloc[0], dtype=bool), int(state["_start"].iloc[0]))

    before = Window.partitionBy("input_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # the page where the segment that is open before each chunk began, as far as is known
        begun = F.coalesce("began", F.when(F.col("chunk") == F.col("_first"), F.col("pages")[0]))
        seen = cur.join(firsts, "input_id").select(*key, begun.alias("began"), "tail", "start", F.last(begun, ignorenulls=True).over(before).alias("_start"), F.lead("chunk").over(Window.partitionBy("input_id").orderBy("chunk")).alias("_next"))
        seen = cut_lineage(seen)
        stale = seen.where(F.col("_start").isNotNull() & ~F.col("_start").eqNullSafe(F.col("start"))).select(*key, "_start")
        count = stale.count()
        if not count:
            break
        if rounds is not None:
            rounds.append(count)
        # totals of chunks from the one where the segment began to each chunk, per component
        own = F.coalesce("began", "_start").alias("_segment")
        cells = seen.select("input_id", "chunk", "_next", own, F.posexplode("tail").alias("_dim", "_x"))
        upto = Window.partitionBy("input_id", "_segment", "_dim").orderBy("chunk")
        sums = cells.withColumn("_s", F.sum("_x").over(upto)).where(F.col("_next").isNotNull())
        sums = sums.select("input_id", F.col("_next").alias("chunk"), "_dim", "_s").join(stale, key, "left_semi")
        sums = sums.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_s"))), lambda c: c["_s"]).alias("s_in"))
        state = stale.join(sums, key).join(fresh.select(*key, "flags"), key)
        work = p.join(stale.select(*key), key, "left_semi")
        redone = work.groupBy(*key).cogroup(state.groupBy(*key)).applyInPandas(again, _CHUNK)
        cur = cut_lineage(cur.join(stale.select(*key), key, "left_anti").unionByName(redone))
    # labels = running count of boundaries - 1, over chunks in order
    counts = cur.select(*key, F.size(F.filter("flags", lambda f: f)).alias("nb"))
    offsets = counts.withColumn("base", F.coalesce(F.sum("nb").over(before), F.lit(0))).drop("nb")
    per_page = cur.join(offsets, key).select(*key, "base", F.explode(F.arrays_zip("pages", "flags")).alias("z")).select(*key, "base", F.col("z.pages").alias("page_no"), F.col("z.flags").alias("flag"))
    within = Window.partitionBy(*key).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return per_page.select("input_id", "page_no", (F.col("base") + F.sum(F.col("flag").cast("int")).over(within) - 1).cast("int").alias("label"))


def boundary_detection(pages: DataFrame, threshold: float | None = None, vec: str = "embedding", spread: bool = True) -> DataFrame:
    """W1. ``spread=True``, for inputs of any size, scans chunks of bounded size in parallel; ``spread=False``, for inputs known
    to be small, folds an input's pages in one task, which holds all their vectors. The caller chooses; the result is the same."""
    return boundary_chunked(pages, threshold, vec) if spread else boundary_fold(pages, threshold, vec)


# ---------------------------------------------------------------- W2
def gap_split(labels: DataFrame, gap: int) -> DataFrame:
    """Split each cluster once, at its first page gap ``> gap``: that page and all later pages of
    the cluster get a new label ``max(label)+1, ...`` in ascending old-label order.

    The gap before a page comes from the page before it in its cluster: a window keyed by (input, label) and a
    strip of ``STRIP_PAGES`` pages, so a large cluster is spread over many keys. The first page of a strip is compared with
    the last one of the cluster's strip before, over one row per strip.
    """
    from ..operators.numbering import number_rows

    g = int(gap)
    lab = labels.select("input_id", "page_no", "label", F.floor(F.col("page_no") / STRIP_PAGES).alias("_strip"))
    before = F.lag("page_no").over(Window.partitionBy("input_id", "label", "_strip").orderBy("page_no"))
    paged = lab.withColumn("_wide", F.col("page_no") - before > g)
    strips = paged.groupBy("input_id", "label", "_strip").agg(
        F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.min(F.when(F.col("_wide"), F.col("page_no"))).alias("cut")
    )
    previous = F.lag("last").over(Window.partitionBy("input_id", "label").orderBy("_strip"))
    cuts = strips.withColumn("at", F.when(F.col("first") - previous > g, F.col("first")).otherwise(F.col("cut")))
    # one row per cluster: written once, as numbering reads it twice
    clusters = cut_lineage(cuts.groupBy("input_id", "label").agg(F.min("at").alias("_cut")))
    top = clusters.groupBy("input_id").agg(F.max("label").alias("_max"))
    ranked = number_rows(clusters.where(F.col("_cut").isNotNull()), "input_id", ["label"], out="_rank").join(top, "input_id")
    ranked = ranked.select("input_id", "label", "_cut", (F.col("_max") + F.col("_rank") + 1).alias("_new"))
    later = F.col("_cut").isNotNull() & (F.col("page_no") >= F.col("_cut"))
    return lab.join(ranked, ["input_id", "label"], "left").select("input_id", "page_no", F.when(later, F.col("_new")).otherwise(F.col("label")).cast("int").alias("label"))

"""Greedy agglomerative merging of one input's pages (numpy; runs inside a Spark task).

Used by the grouped clustering path, one call per input whose size is below the checked bound.
Tie rule: the next merge is the least (distance, min page of A, min page of B) with A < B, with
distances rounded to ``decimals`` places before comparing. A merged cluster keeps the lower id,
so a cluster id is always its lowest page index.
"""

from __future__ import annotations

import numpy as np

INF = np.inf


BLOCK_VALUES = 1 << 23  # differences held at once


def l2_block(x: np.ndarray, y: np.ndarray, values: int = BLOCK_VALUES) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` and ``y``, in row blocks to bound memory (direct differences, no
    ||x||^2 - 2xy expansion, so near-duplicates do not lose digits)."""
    rows = max(1, min(64, values // max(1, y.size)))
    out = np.empty((len(x), len(y)), dtype=np.float64)
    for s in range(0, len(x), rows):
        e, first = min(len(x), s + rows), s if x is y else 0  # of a matrix with itself, the upper half
        diff = x[s:e, None, :] - y[None, first:, :]
        out[s:e, first:] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        if x is y:
            out[e:, s:e] = out[s:e, e:].T
    return out


def blended_matrix(x: np.ndarray, pages: np.ndarray, alpha: float, decimals: int = 9, values: int = BLOCK_VALUES, l2: np.ndarray | None = None) -> np.ndarray:
    """n x n blended distances; ``l2``: the content distances, if they are known."""
    pg = pages.astype(np.float64)
    l2 = l2_block(x, x, values) if l2 is None else l2
    return np.round(alpha * l2 + (1.0 - alpha) * np.abs(pg[:, None] - pg[None, :]), decimals)


def greedy_merges(d: np.ndarray, linkage: str, decimals: int = 9, stop: float | None = None):
    """Merge sequence ``[(a, b, height, size)]`` (indices, a < b) until one cluster remains,
    no finite distance is left, or the next height is ``>= stop``.

    Keeps the upper triangle ``u[r, c]`` (c > r) of cluster linkages and every row's nearest
    partner; after a merge only the rows whose partner changed are re-scanned, all in one
    vectorised call. Single and complete linkage combine already-rounded page distances, so
    only average linkage needs rounding before comparing.
    """
    n = d.shape[0]
    if n < 2:
        return []
    if linkage not in ("average", "complete", "single"):
        raise ValueError(f"unknown linkage: {linkage}")
    u = np.triu(d.astype(np.float64), 1)
    u[np.tril_indices(n)] = INF
    size = np.ones(n, dtype=np.float64)
    active = np.ones(n, dtype=bool)
    rounding = linkage == "average"

    def rescan(rows: np.ndarray) -> None:
        sub = u[rows]
        if rounding:
            sub = np.round(sub, decimals)
        c = np.argmin(sub, axis=1)
        bestc[rows] = c
        bestd[rows] = sub[np.arange(len(rows)), c]

    bestd = np.full(n, INF)
    bestc = np.zeros(n, dtype=np.int64)
    rescan(np.arange(n))
    merges = []
    for _ in range(n - 1):
        a = int(np.argmin(bestd))
        h = bestd[a]
        if not np.isfinite(h) or (stop is not None and h >= stop):
            break
        b = int(bestc[a])
        merges.append((a, b, float(h), int(size[a] + size[b])))
        da = np.concatenate([u[:a, a], u[a, a:]])
        db = np.concatenate([u[:b, b], u[b, b:]])
        if linkage == "average":
            new = (size[a] * da + size[b] * db) / (size[a] + size[b])
        elif linkage == "complete":
            new = np.maximum(da, db)
        else:
            new = np.minimum(da, db)
        new[a] = INF
        new[b] = INF
        new[~active] = INF
        u[:a, a] = new[:a]
        u[a, a + 1 :] = new[a + 1 :]
        u[b, :] = INF
        u[:, b] = INF
        size[a] += size[b]
        active[b] = False
        bestd[b] = INF
        redo = active & ((bestc == a) | (bestc == b))
        redo[a] = True
        # rows above a may now find a nearer (or tied, lower-id) partner in a
        cand = np.round(u[:a, a], decimals) if rounding else u[:a, a]
        better = active[:a] & ~redo[:a] & ((cand < bestd[:a]) | ((cand == bestd[:a]) & (a < bestc[:a])))
        idx = np.nonzero(better)[0]
        bestd[idx] = cand[idx]
        bestc[idx] = a
        rescan(np.nonzero(redo)[0])
    return merges


def settled_merges(d: np.ndarray, size: np.ndarray, core: np.ndarray, linkage: str, decimals: int = 9, stop: float = INF):
    """Merges ``[(a, b, height)]`` below ``stop`` of clusters that are part of a larger input, as far as they are sure: ``settle`` without
    what waits."""
    return settle(d, size, core, linkage, decimals, stop)[0]


def settle(d: np.ndarray, size: np.ndarray, core: np.ndarray, linkage: str, decimals: int = 9, stop: float = INF):
    """Merges ``[(a, b, height)]`` below ``stop`` of clusters that are part of a larger input, as far as they are sure; and which of the clusters
    are settled.

    ``d``: linkages of all cluster pairs, ``size``: pages of each cluster, ``core``: the clusters whose neighbours below
    ``stop`` are all here. The others may merge elsewhere, so a core cluster whose nearest neighbour is one of them waits:
    from then on it counts as one of them. A pair merges when both are core and each other's nearest; by reducibility
    it merges whatever the others do. A core cluster that doesn't wait in the end has no neighbour below ``stop``, and by
    reducibility never gets one: it is settled.
    """
    n = d.shape[0]
    u = np.triu(d.astype(np.float64), 1)
    u[np.tril_indices(n)] = INF
    size, core, gone = size.astype(np.float64), core.copy(), np.zeros(n, dtype=bool)
    u[np.ix_(~core, ~core)] = INF
    bestd, bestc = np.full(n, INF), np.zeros(n, dtype=np.int64)

    def rescan(rows: np.ndarray) -> None:
        if len(rows):
            sub = np.round(u[rows], decimals)
            bestc[rows] = np.argmin(sub, axis=1)
            bestd[rows] = sub[np.arange(len(rows)), bestc[rows]]

    rescan(np.arange(n))
    merges = []
    while n:
        a = int(np.argmin(bestd))
        h, b = float(bestd[a]), int(bestc[a])
        if not h < stop:
            break
        if not (core[a] and core[b]):
            x = a if core[a] else b
            waits = np.nonzero(~core)[0]
            core[x] = False
            u[x, waits] = INF
            u[waits, x] = INF
            rescan(np.unique(np.append(waits[bestc[waits] == x], x)))
            continue
        merges.append((a, b, h))
        da, db = np.concatenate([u[:a, a], u[a, a:]]), np.concatenate([u[:b, b], u[b, b:]])
        new = (size[a] * da + size[b] * db) / (size[a] + size[b]) if linkage == "average" else np.maximum(da, db)
        gone[b] = True
        new[gone] = INF
        new[a] = INF
        u[:a, a] = new[:a]
        u[a, a + 1 :] = new[a + 1 :]
        u[b, :] = INF
        u[:, b] = INF
        size[a] += size[b]
        redo = ~gone & ((bestc == a) | (bestc == b))
        redo[a] = True
        bestd[b] = INF
        cand = np.round(u[:a, a], decimals)
        better = ~gone[:a] & ~redo[:a] & ((cand < bestd[:a]) | ((cand == bestd[:a]) & (a < bestc[:a])))
        idx = np.nonzero(better)[0]
        bestd[idx], bestc[idx] = cand[idx], a
        rescan(np.nonzero(redo)[0])
    return merges, core


def settle_rounds(d: np.ndarray, core: np.ndarray, linkage: str, decimals: int = 9, stop: float = INF):
    """As ``settle`` for single pages: merges ``[(a, b, height)]``, heights not in order, and which of the clusters are settled. All core clusters that are
    each other's nearest merge at once, and clusters that are settled leave the matrix. Overwrites ``d``."""
    n, average = len(d), linkage == "average"
    at, size, core, settled = np.arange(n), np.ones(n), core.copy(), np.zeros(n, dtype=bool)
    np.fill_diagonal(d, INF)
    merges = []
    while len(at):
        v = np.round(d / np.outer(size, size), decimals) if average else d
        near = v.argmin(axis=1)
        i, best = np.arange(len(at)), v[np.arange(len(at)), near]
        over = core & ~(best < stop)
        settled[at[over]] = True
        waits = core & ~over & ~core[near]
        lo = np.flatnonzero(core & core[near] & (near[near] == i) & (i < near) & (best < stop))
        if not (len(lo) or waits.any()):
            break
        hi = near[lo]
        merges += zip(at[lo].tolist(), at[hi].tolist(), best[lo].tolist())
        core = core & ~waits
        if len(lo):
            both = np.add if average else np.maximum
            d[lo] = both(d[lo], d[hi])
            d[:, lo] = both(d[:, lo], d[:, hi])
            d[lo, lo] = INF
            size[lo] += size[hi]
            keep = ~over
            keep[hi] = False
            keep = np.flatnonzero(keep)
            d, at, size, core = d[np.ix_(keep, keep)], at[keep], size[keep], core[keep]
    return merges, settled


def labels_at(n: int, merges, threshold: float) -> np.ndarray:
    """Cluster id (lowest member index) of every index after the merges with height < threshold."""
    parent = np.arange(n)
    for a, b, h, _ in merges:
        if h < threshold:
            parent[b] = a
    # ids only decrease along parent links, so one pass in index order resolves every chain
    for i in range(n):
        parent[i] = parent[parent[i]]
    return parent

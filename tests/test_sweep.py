"""Merge trees of inputs longer than a block against the one-task path: spanning forests, rows of distances, intervals of labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import forest, rowstore, sweep
from quire.operators.cluster import cluster_pages, threshold_sweep
from quire.operators.merge import blended_matrix, greedy_merges, l2_block, labels_at


def _pages(spark, sizes, kinds=0, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        base = np.eye(5)[rng.integers(0, kinds, n)] if kinds else np.cumsum(rng.normal(size=(n, 5)) * 0.25, axis=0)
        rows += [(f"in:{k}", p + p // 9, base[p].tolist()) for p in range(n)]  # some page numbers are missing
    return spark.createDataFrame(rows, "input_id string, page_no int, embedding array<double>")


def _rows(df):
    return sorted((r.input_id, r.threshold, r.page_no, r.label) for r in df.collect())


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
@pytest.mark.parametrize("alpha,kinds", [(0.8, 0), (1.0, 3), (1.2, 0)])
def test_sweep_of_long_inputs_equals_merge_sequences(spark, linkage, alpha, kinds):
    pages = _pages(spark, [1, 15, 8], kinds)
    ts = [1.4, 0.2, 0.7, 1.0]
    assert _rows(threshold_sweep(pages, alpha, ts, linkage, block=6)) == _rows(threshold_sweep(pages, alpha, ts, linkage, spread=False))


def test_labels_of_a_sweep_are_spread_without_a_shuffle(spark):
    labels = sweep.long_labels(_pages(spark, [30]), 0.8, "average", [0.2, 0.7, 1.0], block=6)
    assert labels._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_one_threshold_without_a_band(spark):
    pages = _pages(spark, [20, 3])
    one, two = ({(r.input_id, r.page_no): r.label for r in cluster_pages(pages, 1.1, 0.8, "complete", spread=s).collect()} for s in (True, False))
    assert one == two


def test_forest_of_edges():
    rng = np.random.default_rng(1)
    for n in (2, 9, 60):
        w = rng.integers(0, 6, (n, n)) * 1.0
        i, j = np.triu_indices(n, 1)
        order = np.lexsort((j, i, w[i, j]))
        i, j = i[order], j[order]
        kept = forest.spanning_forest(n, i, j)
        parent, total, count = list(range(n)), 0.0, 0

        def root(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for a, b in zip(i, j):  # Kruskal
            if root(a) != root(b):
                parent[root(a)] = root(b)
                total, count = total + w[a, b], count + 1
        assert (len(kept), w[i[kept], j[kept]].sum()) == (count, total)
    assert forest.spanning_forest(3, np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_rounds_of_a_long_chain(spark):
    """Distances rise along the chain, so merging nearest pairs one after the other would need a round per page."""
    n = 1200
    at = np.cumsum(0.001 * np.arange(n))
    pages = spark.createDataFrame([("c", p, [float(at[p])]) for p in range(n)], "input_id string, page_no int, embedding array<double>")
    spans, rounds = forest.forest_spans(pages, {"0": 1.0}, 0.9005, block=100)
    assert rounds <= math.log2(n) + 2
    got = {r.page_no for r in spans.where((F.col("low") < 0.9) & (F.col("high") >= 0.9)).groupBy("label").agg(F.min("page_no").alias("page_no")).collect()}
    x = at[:, None]
    merged = {b for _, b, h, _ in greedy_merges(np.round(l2_block(x, x), 9), "single", stop=0.9)}
    assert got == set(range(n)) - merged


def test_rows_of_distances_stay_symmetric():
    rng = np.random.default_rng(2)
    n = 14
    d = np.round(rng.random((n, n)), 2)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, np.inf)
    for complete in (False, True):
        rows, sizes = {p: d[p].copy() for p in range(n)}, rng.integers(1, 5, n).astype(float)
        lo, hi = np.array([0, 2, 5]), np.array([9, 3, 13])
        after = [rowstore.merged_row(rows[p], rows[hi[list(lo).index(p)]] if p in lo else None, p, int(sizes[p]), int(sizes[hi[list(lo).index(p)]]) if p in lo else 0, lo, hi, sizes, complete) for p in range(n) if p not in hi]
        m = np.array(after)
        assert m.shape == (11, 11) and (m == m.T).all() and np.isinf(np.diag(m)).all()


def test_a_page_has_few_intervals(spark):
    pages = _pages(spark, [60], seed=9)
    levels = [x / 10 for x in range(1, 51)]
    spans = sweep.long_spans(pages, {0: (0.8, "average"), 1: (0.8, "single")}, levels, block=16).collect()
    assert len(spans) < 0.2 * 2 * 60 * len(levels)
    for setting in "01":
        for p in range(60):
            own = sorted((r["first"], r["last"]) for r in spans if r["page_no"] == p + p // 9 and r["input_id"].startswith(setting))
            assert own[0][0] == 0 and own[-1][1] == 49 and all(b[0] == a[1] + 1 for a, b in zip(own, own[1:]))


def test_merges_of_a_forest_equal_greedy_ones():
    rng = np.random.default_rng(6)
    for n, kinds in ((1, 0), (2, 0), (40, 0), (40, 3)):
        x = np.eye(4)[rng.integers(0, kinds, n)] if kinds else rng.normal(size=(n, 4))
        d = blended_matrix(x, np.arange(n), 0.9)
        for t in (0.4, 1.0, 2.5):
            assert (labels_at(n, forest.single_merges(d, 2.5), t) == labels_at(n, greedy_merges(d, "single", stop=2.5), t)).all()

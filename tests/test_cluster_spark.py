"""Clustering in Spark: grouped path, distributed rounds path (with band pruning) and the
numpy reference agree; band pruning equals no pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.cluster import cluster_grouped, cluster_pages, threshold_sweep
from quire.operators.merge import blended_matrix, greedy_merges, labels_at
from quire.operators.pairs import band_width, page_pairs
from quire.operators.components import single_linkage_components
from quire.operators.rounds import cluster_rounds


def _pages(spark, n_inputs=3, n=20, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_inputs):
        # runs of similar vectors so there is real structure
        centres = rng.normal(size=(4, dim))
        for p in range(n):
            v = centres[(p * 4) // n] + 0.3 * rng.normal(size=dim)
            rows.append((f"in{k}", p, [float(z) for z in v / np.linalg.norm(v)]))
    return spark.createDataFrame(rows, "input_id string, page_no int, embedding array<double>")


def _expected(pdf_rows, alpha, t, linkage):
    out = {}
    by = {}
    for r in pdf_rows:
        by.setdefault(r["input_id"], []).append(r)
    for k, rs in by.items():
        rs.sort(key=lambda r: r["page_no"])
        x = np.array([r["embedding"] for r in rs])
        pages = np.array([r["page_no"] for r in rs])
        lab = labels_at(len(rs), greedy_merges(blended_matrix(x, pages, alpha), linkage), t)
        for p, lb in zip(pages, lab):
            out[(k, int(p))] = int(pages[lb])
    return out


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_grouped_and_rounds_match_numpy(spark, linkage):
    pages = _pages(spark)
    rows = pages.collect()
    for alpha, t in [(0.85, 2.0), (0.9, 1.5)]:
        exp = _expected(rows, alpha, t, linkage)
        g = {(r.input_id, r.page_no): r.label for r in cluster_grouped(pages, alpha, t, linkage).collect()}
        assert g == exp
        rd = {(r.input_id, r.page_no): r.label for r in cluster_rounds(pages, alpha, t, linkage).collect()}
        assert rd == exp


def _labels(df):
    return {(r.input_id, r.page_no): r.label for r in df.collect()}


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_spread_gives_the_labels_of_the_grouped_path(spark, linkage):
    pages = _pages(spark, n_inputs=2, n=16)
    assert _labels(cluster_pages(pages, 0.85, 1.6, linkage)) == _labels(cluster_pages(pages, 0.85, 1.6, linkage, spread=True))


@pytest.mark.parametrize("alpha,t", [(0.85, 2.0), (0.6, 1.7), (1.0, 1.1), (1.2, 1.0)])
def test_rounds_on_ties(spark, alpha, t):
    """Few different vectors, so most distances are tied; topics alternate, so clusters overlap in page range and enter the band late."""
    rng = np.random.default_rng(8)
    kinds = np.eye(4)[:, :4]
    rows = [(f"in{k}", p, kinds[(p // (k + 1)) % 3 if p % 7 else rng.integers(4)].tolist()) for k in range(3) for p in range(26)]
    pages = spark.createDataFrame(rows, "input_id string, page_no int, embedding array<double>")
    for linkage in ("average", "complete"):
        assert _labels(cluster_rounds(pages, alpha, t, linkage)) == _expected(pages.collect(), alpha, t, linkage), linkage


def test_only_pairs_in_the_band_are_summed(spark):
    """A long input at a narrow band: the pair table stays far below all page pairs."""
    from quire.operators import rounds as R

    pages = _pages(spark, n_inputs=1, n=300)
    clusters = pages.select("input_id", F.col("page_no").alias("cl"), F.lit(1).cast("long").alias("n"), F.col("page_no").cast("long").alias("pages"))
    near = R._in_band(clusters, band_width(0.85, 1.5)).collect()
    assert len(near) == len(set(near)) == sum(min(9, 299 - i) for i in range(300)) and all(r.ca < r.cb for r in near)


def test_matrix_blocks_do_not_change_distances():
    x = np.random.default_rng(0).normal(size=(50, 1536))
    pages = np.arange(50)
    assert (blended_matrix(x, pages, 0.85, values=1) == blended_matrix(x, pages, 0.85)).all()


def test_band_pruning_is_exact_for_pairs_below_threshold(spark):
    pages = _pages(spark, n_inputs=2, n=40)
    alpha, t = 0.85, 2.0
    w = band_width(alpha, t)
    full = page_pairs(pages, alpha, block=7).where(F.col("dist") < t)
    band = page_pairs(pages, alpha, max_gap=w, block=7).where(F.col("dist") < t)
    a = sorted(tuple(r) for r in full.collect())
    b = sorted(tuple(r) for r in band.collect())
    assert a == b and len(a) > 0


def test_tiled_pairs_cover_every_pair_once(spark):
    pages = _pages(spark, n_inputs=2, n=23)
    got = page_pairs(pages, 0.85, block=5).select("input_id", "i", "j").collect()
    assert len(got) == 2 * 23 * 22 // 2
    assert len(set(tuple(r) for r in got)) == len(got)


def test_components_equal_single_linkage(spark):
    pages = _pages(spark, n_inputs=3, n=30, seed=11)
    rows = pages.collect()
    for alpha, t in [(0.85, 2.0), (0.85, 1.36), (0.9, 1.5), (1.1, 1.8)]:
        exp = _expected(rows, alpha, t, "single")
        got = {(r.input_id, r.page_no): r.label for r in single_linkage_components(pages, alpha, t).collect()}
        assert got == exp, (alpha, t)


def test_other_distances(spark):
    """Distance by pages alone: clusters are runs of neighbours, in either path."""
    pages = _pages(spark, n_inputs=2, n=11)
    one = cluster_pages(pages, threshold=1.5, linkage="complete", matrix=lambda x, p: np.abs(p[:, None] - p[None, :]).astype(float))
    two = cluster_pages(pages, threshold=1.5, linkage="complete", spread=True, distance=lambda vi, vj, i, j: F.abs(F.col(i) - F.col(j)).cast("double"))
    assert _labels(one) == _labels(two) and {p: c for (k, p), c in _labels(one).items() if k == "in0"} == {p: p - p % 2 for p in range(11)}

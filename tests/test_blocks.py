"""Clustering in blocks of pages against the one-task path, and the paths that are taken without being named."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, cluster, evaluate, segment
from quire.plans import queries, split


def _labels(df):
    return {(r.input_id, r.page_no): r.label for r in df.collect()}


def _pages(spark, sizes, seed=3, kinds=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        centre = rng.normal(size=(n, 6)) * 0.5
        base = np.eye(6)[rng.integers(0, kinds, n)] if kinds else np.repeat(centre[: n // 4 + 1], 4, 0)[:n] + rng.normal(size=(n, 6)) * 0.15
        rows += [(f"in:{k}", p, base[p].tolist()) for p in range(n)]
    return spark.createDataFrame(rows, "input_id string, page_no int, embedding array<double>")


@pytest.mark.parametrize("linkage", ["average", "complete"])
@pytest.mark.parametrize("alpha,t,block,kinds", [(0.6, 1.0, 8, 0), (0.85, 1.2, 20, 0), (0.85, 1.6, 24, 3)])
def test_blocks_equal_the_matrix_of_the_input(spark, linkage, alpha, t, block, kinds):
    pages = _pages(spark, [1, 7, 90, 61], kinds=kinds)
    assert _labels(blocks.block_labels(pages, alpha, t, linkage, block=block)) == _labels(cluster.cluster_pages(pages, alpha, t, linkage, spread=False))


def test_a_long_input_is_cut_by_default(spark):
    pages = _pages(spark, [2300, 40])
    seen = []
    fn = blocks._block_fn

    def counted(settings, threshold):
        inner, most = fn(settings, threshold), 2 * blocks.BLOCK

        def checked(pdf):
            assert len(pdf) < most, "a task holds more than a block"
            return inner(pdf)

        seen.append(1)
        return checked

    blocks._block_fn = counted
    try:
        got = _labels(cluster.cluster_pages(pages))
    finally:
        blocks._block_fn = fn
    assert len(seen) >= 3 and got == _labels(cluster.cluster_pages(pages, spread=False))


def test_settled_pages_are_not_measured_again(spark):
    pages = _pages(spark, [2300, 40])
    rounds = []
    fn = blocks._block_fn

    def counted(settings, threshold):
        inner, later = fn(settings, threshold), len(rounds) > 0

        def checked(pdf):
            assert not later or len(pdf) < blocks.BLOCK / 4, "a later round holds settled pages"
            return inner(pdf)

        rounds.append(1)
        return checked

    blocks._block_fn = counted
    try:
        got = _labels(cluster.cluster_pages(pages))
    finally:
        blocks._block_fn = fn
    assert len(rounds) >= 2 and got == _labels(cluster.cluster_pages(pages, spread=False))


def test_the_path_without_a_limit_is_the_default():
    for f in (cluster.cluster_pages, cluster.threshold_sweep, evaluate.grid_contingency, evaluate.grid_search, segment.boundary_detection, split.page_labels, split.split_with_pages):
        assert inspect.signature(f).parameters["spread"].default is True, f
    for q in (queries._f2_labels, queries.q_boundary_detection, queries.q_split_levels, queries._search):
        assert "spread=False" not in inspect.getsource(q)


def test_boundaries_with_pages_missing(spark):
    pages = _pages(spark, [90, 5], kinds=3).where("page_no NOT BETWEEN 12 AND 41 AND page_no % 7 != 0")
    assert _labels(segment.boundary_chunked(pages, 0.6, chunk=8)) == _labels(segment.boundary_fold(pages, 0.6))

"""The pivot join against all pairs: nothing below the threshold is lost, and tiles are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import pairs


def _pages(spark, sizes, seed=0):
    """Pages around a few centres, many of them equal."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        centres = rng.normal(size=(5, 6)) * 4
        for p in range(n):
            v = centres[rng.integers(5)] + (0 if p % 3 == 0 else 0.3) * rng.normal(size=6)
            rows.append((f"in{k}", 2 * p, v.tolist()))
    return spark.createDataFrame(rows, "input_id string, page_no int, embedding array<double>")


@pytest.mark.parametrize("alpha,t", [(1.0, 0.8), (1.0, 0.0), (1.2, 0.5), (1.05, -3.0), (0.9, 2.0)])
def test_pairs_below_a_threshold(spark, alpha, t):
    pages = _pages(spark, [1, 90, 33])
    want = pairs.page_pairs(pages, alpha, block=16).where(F.col("dist") < t)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got = key(pairs.metric_pairs(pages, alpha, t, block=8))
    assert got == key(want) and len({r[:3] for r in got}) == len(got)


def test_tiles_are_left_out_and_blocks_are_even(spark):
    pages = _pages(spark, [400])
    blocks = pairs.pivot_blocks(pages, block=10)
    sizes = [r["count"] for r in blocks.groupBy("blk").count().collect()]
    assert len(sizes) == 40 and set(sizes) == {10}
    assert pairs.metric_tiles(blocks, 1.0, 0.8).count() < 0.4 * 40 * 41 / 2
    assert pairs.metric_tiles(blocks, 1.0, 1e6).count() == 40 * 41 / 2
    same = spark.createDataFrame([("e", p, [1.0, 2.0]) for p in range(100)], "input_id string, page_no int, embedding array<double>")
    assert pairs.metric_pairs(same, 1.0, 1e-6, block=9).count() == 4950
    assert pairs.metric_pairs(pages.limit(0), 1.0, 1.0).collect() == []
    with pytest.raises(ValueError):
        pairs.metric_pairs(pages, -0.5, 1.0)


def test_pairs_are_measured_in_tasks_by_matrix(spark):
    """No joined row per pair of pages of two blocks: of 1,500 distant pages and two near ones only the near pair leaves the tasks."""
    rng = np.random.default_rng(5)
    rows = [("a", p, (rng.normal(size=6) * 100).tolist()) for p in range(1500)]
    rows.append(("a", 1500, [x + 1e-4 for x in rows[700][2]]))
    pages = spark.createDataFrame([*rows, ("a", 1501, None), ("a", None, [0.0] * 6)], "input_id string, page_no int, embedding array<double>")
    got = pairs.metric_pairs(pages, 1.0, 0.01, block=100)
    assert [tuple(r)[:3] for r in got.collect()] == [("a", 700, 1500)] and [t for _, t in got.dtypes] == ["string", "int", "int", "double"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan
    r, c, l2 = pairs.near_cells(np.eye(3), np.eye(3), np.arange(3), np.arange(3), 1.0, 0.5)
    assert r.tolist() == c.tolist() == [0, 1, 2] and not l2.any()

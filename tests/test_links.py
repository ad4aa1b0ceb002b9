"""Copies and numbers of near pages against all pairs, with large groups of copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import links

SCHEMA = "input_id string, page_no int, embedding array<double>"


def _brute(rows, threshold):
    out = []
    for key, page, v in rows:
        alike = [(p, w) for k, p, w in rows if k == key and v is not None and w is not None]
        first = min([p for p, w in alike if w == v], default=page)
        n = sum(round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9) < threshold for p, w in alike if p != page)
        out.append((key, page, first, n))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.0, 0.4, 1.1])
def test_links_equal_all_pairs(spark, threshold):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 150), ("b", 1), ("c", 40)):
        centres = rng.normal(size=(6, 4))
        for page in range(n):
            v = centres[rng.integers(6)] + (0 if page % 2 else 0.2) * rng.normal(size=4)
            rows.append((key, 3 * page, [0.0] * 4 if page % 19 == 7 else v.tolist()))
    rows += [("a", 1000, None), ("d", 0, None)]
    got = links.near_links(spark.createDataFrame(rows, SCHEMA), threshold, block=16)
    assert sorted(map(tuple, got.collect())) == _brute(rows, threshold)


def test_copies_are_compared_once(spark):
    rows = spark.range(30_000).select(
        F.lit("hot").alias("input_id"), F.col("id").cast("int").alias("page_no"), F.when(F.col("id") < 20_000, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), (F.col("id") % 4) * 10.0)).alias("embedding")
    )
    assert links.copy_classes(rows).count() == 5
    got = links.near_links(rows, 0.5).groupBy("class_page", "n_links").count().collect()
    assert sorted(map(tuple, got)) == [(0, 19_999, 20_000), *[(20_000 + k, 2_499, 2_500) for k in range(4)]]


def test_a_block_of_near_copies_makes_counts_only(spark):
    rows = spark.range(3000).select(F.lit("x").alias("input_id"), F.col("id").cast("int").alias("page_no"), F.array(F.col("id") / 1e6, F.lit(1.0)).alias("embedding"))
    counts = links.class_links(links.copy_classes(rows), 0.5, block=500)
    assert [tuple(r) for r in counts.agg(F.count("n"), F.min("n"), F.max("n")).collect()] == [(3000, 2999, 2999)]


def test_pairs_at_the_threshold_are_decided_by_differences():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 5)), 1e4 + rng.integers(0, 3, (60, 5)), np.zeros((3, 5))])
    for y in (x, x[:40] + 0.5):
        d = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), 9)
        for t in (-1.0, 0.0, 1e-9, 1.0, float(d[1, 2]), float(d[70, 5]), 1e6):
            assert (links.near_matrix(x, y, t, chunk=7) == (d < max(t, 0))).all()


def test_empty_table_and_extra_columns(spark):
    rows = spark.createDataFrame([("a", 0, [1.0], 9), ("a", 1, [1.0], 9)], SCHEMA + ", size int")
    assert links.near_links(rows.limit(0), 1.0).collect() == []
    assert sorted(map(tuple, links.near_links(rows, 1.0).collect())) == [("a", 0, 0, 1), ("a", 1, 0, 1)]

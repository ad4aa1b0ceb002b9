"""Stores of distances: what needs none, and what is kept of them."""

import os

import numpy as np
import pyarrow.dataset as ds

from quire.operators import cluster, rowstore, sweep
from quire.session import checkpoint_dir


def _pages(spark, sizes):
    rng = np.random.default_rng(7)
    rows = []
    for k, n in enumerate(sizes):
        x = np.abs(rng.normal(size=(n, 5))) * (rng.random((n, 5)) < 0.4)
        rows += [(f"in:{k}", p, v.tolist()) for p, v in enumerate(x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None])]
    return spark.createDataFrame(rows, "input_id string, page_no int, embedding array<double>")


def _sorted(df):
    return sorted((r.input_id, r.threshold, r.page_no, r.label) for r in df.collect())


def test_average_linkage_of_attracting_pages_needs_no_store(spark, monkeypatch):
    pages, stored = _pages(spark, [6, 90]), []

    def counted(pages, settings, *rest):
        stored.extend(r.input_id for r in pages.select("input_id").distinct().collect())
        return rowstore.store_merges(pages, settings, *rest)

    monkeypatch.setattr(sweep, "store_merges", counted)
    thresholds = [1.3, 2.25]
    got = _sorted(cluster.threshold_sweep(pages, 1.1, thresholds, "average", block=5))
    assert got == _sorted(cluster.threshold_sweep(pages, 1.1, thresholds, "average", spread=False))
    assert stored == ["in:0"]


def test_inputs_are_sure_only_where_merging_says_so(spark):
    pages = _pages(spark, range(1, 90, 3))
    for alpha, t in ((1.1, 1.3), (1.2, 0.4), (1.5, -1.0), (2.0, -5.0)):
        sure = {r.input_id: r.low for r in rowstore.sure_inputs(pages, [alpha], t).collect()}
        merged = cluster.threshold_sweep(pages, alpha, [t], "average", spread=False).groupBy("input_id").agg({"label": "max"}).collect()
        assert sure and all(low == 0 for low in sure.values())
        assert set(sure) <= {r.input_id for r in merged if r["max(label)"] == 0}
    odd = pages.where("input_id = 'in:24'").selectExpr("input_id", "page_no", "if(page_no = 3, null, embedding) AS embedding")
    assert rowstore.sure_inputs(odd, [1.2], 1.3).count() == 0 and rowstore.sure_inputs(odd.where("page_no != 3"), [1.2], 1.3).count() == 1
    assert rowstore.sure_inputs(odd.where("page_no != 3").selectExpr("input_id", "page_no % 60 AS page_no", "embedding"), [1.2], 1.3).count() == 0


def test_rounds_keep_two_stores(spark):
    tables = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    merges = rowstore.store_merges(_pages(spark, [14]), {0: (1.1, "complete")}, 2.25)
    assert merges.count() == 13
    new = [t for t in os.listdir(tables) if t not in before]
    kinds = [ds.dataset(f"{tables}/{t}", format="parquet", exclude_invalid_files=True).schema.names for t in new]
    assert sum("row" in k or "parts" in k for k in kinds) == 2 and len(kinds) > 12

"""Benchmark (BENCH_LONG=1 adds the clustering of one long input by rounds): headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line,
and each query's time to stderr as it ends.

Each query runs to completion through the ``noop`` sink (every row computed, nothing
collected to the driver). Times are wall seconds per query, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quire.operators.cluster import cluster_pages  # noqa: E402
from quire.operators.numbering import number_rows  # noqa: E402
from quire.operators.vectorize import text_vectors  # noqa: E402
from quire.plans import queries as Q  # noqa: E402
from quire.session import cut_lineage, local_session, ship_package  # noqa: E402
from quire.sources import tables  # noqa: E402

HEADLINE = [
    "text_vectors",
    "page_pairs",
    "cluster_average",
    "cluster_complete",
    "cluster_single",
    "boundary_detection",
    "gap_split",
    "assign_topics",
    "page_text",
    "page_explode",
    "adjusted_rand",
    "grid_search",
]


def long_input(spark, sf_dir):
    """All documents as the pages of one input (10,000 at sf0.1), clustered by average linkage spread over tasks."""
    pages = tables.text_pages(spark, sf_dir).select(F.lit("all").alias("input_id"), F.struct("input_id", "page_no").alias("place"), "text")
    pages = cut_lineage(number_rows(pages, "input_id", ["place"], out="page_no").select("input_id", "page_no", "text"))
    vectors = cut_lineage(text_vectors(pages).select("input_id", "page_no", "embedding"))
    return cluster_pages(vectors, linkage="average", spread=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="quire-bench")
    ship_package(spark)
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-bench-ckpt-"))
    reg = Q.registry()
    Q.q_page_numbering(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    reg["cluster_spread_long"] = long_input
    for name in [*HEADLINE, *["cluster_spread_long"] * bool(os.environ.get("BENCH_LONG"))]:
        t0 = time.time()
        reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

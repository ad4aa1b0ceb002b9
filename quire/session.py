"""Session helpers: a tuned local session for tests/bench and checkpoint-dir lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller's session is used as is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # local data is tiny and text work is CPU-bound: keep one shuffle partition per core
        # instead of letting AQE merge partitions by bytes (on a cluster, keep AQE coalescing)
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session without one (tests, bench) gets a fresh scratch folder;
    on a cluster an unset directory is an error, never a machine-local fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; iterative operators need a shared folder")
    path = tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("QUIRE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    The result survives executor loss (files in the cluster's folder, not executor memory), its
    plan is a plain file scan whatever came before (iterative rounds do not grow their plans),
    and the scan carries real file sizes, so later joins can be planned on them.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a known schema needs no job that looks into the files


def cut_lineage_by_turns(spark: SparkSession):
    """``cut_lineage`` for a large table that each round makes anew from the last one: two folders take turns, so
    what is kept is the last table and the one it came from, whatever the number of rounds."""
    import itertools
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    turns = itertools.cycle("ab")

    def cut(df):
        at = f"{path}_{next(turns)}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return cut


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in every Python worker: zip the package once per application
    and register it with ``addPyFile`` (Spark copies it to each executor, as ``--py-files``
    would). Grouped-map and pandas UDF code refers to ``quire`` functions by module name."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quire-pyfiles-"), "quire.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)

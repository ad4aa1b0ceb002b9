"""P1 page numbering: dense 0-based position of each row inside its input.

Equivalent to ``row_number() OVER (PARTITION BY key ORDER BY order) - 1`` but does not send a
whole input to one task: the rows are range-partitioned by (key, order), take their position in the
partition along, and each partition's offset inside an input comes from a small table of
per-partition counts. A hot input that spans many partitions is numbered by many tasks.

Positions belong to rows, not to values, so n rows give n rows whatever repeats. Rows equal in key and order are told
apart by the partition they came from, so that even a group of them is spread over many tasks; which of them
comes first is not defined.

The rows with their positions are written once (a table in the checkpoint folder) before the offsets are joined to them:
positions come from a shuffle, and two evaluations of a shuffle (e.g. after AQE
coalesces partitions differently, or a lost executor) need not give the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition index << 33) + row in partition


def number_rows(df: DataFrame, key: str, order: list[str], out: str = "page_no") -> DataFrame:
    """Add ``out`` (INT, 0-based) = rank of the row in ``order`` within ``key``, nulls first. Every row is kept, also of a null key,
    with null order values, or repeated; the ranks of a key's n rows are 0 to n - 1."""
    cols = [key, *order]
    placed = (
        df.withColumn("_from", F.spark_partition_id())
        .repartitionByRange(*cols, "_from")
        .sortWithinPartitions(*cols)
        .drop("_from")
        .withColumn("_mid", F.monotonically_increasing_id())
        .select(*df.columns, F.shiftright("_mid", _LOCAL_BITS).alias("_part"), F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"))
    )
    placed = cut_lineage(placed)
    spans = placed.groupBy("_part", key).agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # written as well: with the size of its files known, the few rows are sent to the pages, which need no shuffle to meet them
    spans = cut_lineage(spans.select(F.col("_part").alias("_s_part"), F.col(key).alias("_s_key"), "_first", "_offset"))
    # null-safe, so the rows of a null key are numbered like those of any other
    whole = placed.join(spans, (F.col("_part") == F.col("_s_part")) & F.col(key).eqNullSafe(F.col("_s_key")))
    return whole.select(*df.columns, (F.col("_offset") + F.col("_local") - F.col("_first")).cast("int").alias(out))


def dense_rank_within(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Dense 0-based rank of ``col`` within ``key``, ranked over the distinct (key, col) pairs
    only (for low-cardinality ``col`` such as a language)."""
    distinct = df.select(key, col).distinct()
    ranked = distinct.withColumn(out, (F.dense_rank().over(Window.partitionBy(key).orderBy(col)) - 1).cast("int"))
    renamed = cut_lineage(ranked.select(F.col(key).alias("_r_key"), F.col(col).alias("_r_col"), out))  # of known size, so few rows don't shuffle ``df``
    return df.join(renamed, df[key].eqNullSafe(F.col("_r_key")) & df[col].eqNullSafe(F.col("_r_col"))).drop("_r_key", "_r_col")

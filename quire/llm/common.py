"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes of rows that a Python worker gets at a time (one longer row alone). Spark's default is 64 MB.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Python workers of this application can import the package, and get rows in batches of bounded size."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the cluster's shared checkpoint folder."""
    return cut_lineage(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)

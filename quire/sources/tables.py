"""Readers of the given tables and the page-stream views derived from them (FIXTURES.md F1-F5).

Every view is ``(input_id STRING, page_no INT, ...)`` with ``page_no`` 0-based and dense.
Only the needed columns are selected so the Parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import dense_rank_within, number_rows

# Our choice for F1: fixed-size inputs cut from the vector table; for F3: lines per page.
VECTORS_PER_INPUT = 50
LINES_PER_PAGE = 3
# the input of the rows without a source or an address, so that joins by input keep them. The control
# character keeps it apart from names.
NO_INPUT = "\u0001none"


# a row id per given table, used to spread a scan that is one split
_ROW_IDS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "conversations": "conv_id", "labels": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A scan of several splits is left as it is. One that is a single split (so at most
    ``spark.sql.files.maxPartitionBytes``, or one row group) is dealt out by its row id, so that text work runs on every core. The plan follows
    the number of splits so; results don't."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in _ROW_IDS and df.rdd.getNumPartitions() == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism, _ROW_IDS[name])
    return df


def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` cut into inputs of 50 vectors, pages ordered by (label, vec_id).

    Columns: input_id, page_no, vec_id, embedding ARRAY<DOUBLE>, gold INT.
    """
    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / VECTORS_PER_INPUT).cast("string").alias("input_id"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("int").alias("gold"),
    )
    return number_rows(e, "input_id", ["gold", "vec_id"])


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` bundled per source, pages ordered by (lang, doc_id), gold = rank of lang.

    Columns: input_id, page_no, doc_id, lang, text, gold INT.
    """
    d = table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit(NO_INPUT)).alias("input_id"), "doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    d = dense_rank_within(d, "input_id", "lang", "gold")
    return number_rows(d, "input_id", ["lang", "doc_id"])


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 input: one long text per input (``documents``), stem ``doc_{doc_id}``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("input_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """web ``pages`` bundled per host, ordered by page_id. Columns: input_id, page_no, page_id, url, html."""
    p = table(spark, sf_dir, "pages").select(
        F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit(NO_INPUT)).alias("input_id"), "page_id", "url", "html"
    )
    return number_rows(p, "input_id", ["page_id"])

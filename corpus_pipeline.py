"""From documents to packed token sequences: quality, near-duplicates, personal data, mixing, packing.

Each stage calls one operator of ``quire.llm`` on all that the one before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bytecnn, mixing, packing, pii, simhash
from quire.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the byte-level network scores below 0.3."""
    return bytecnn.keep_good(docs, bytecnn.fit(docs, table(spark, sf_dir, "labels")), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints link at 4 or fewer bits (shingles of 4 words)."""
    return simhash.one_of_each(docs, width=4, radius=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its place in a sequence."""
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: The classifier is trained and texts are tokenized, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))

"""P5 text vectorisation and S4 reuse of stored vectors.

The default vectoriser is hashed term counts: every word goes to cell
``int(first 8 hex digits of md5(word), 16) mod D``, counts are L2-normalised. A row's vector depends on its own text only, so it is
made where the row is: words are split by Spark and counted per row in one Arrow pass, without any shuffle. It can be replaced by any DataFrame -> DataFrame function,
e.g. a ``mapInPandas`` model, with the same output columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..constants import HASH_CELLS
from ..functions.text import WORD_SPLIT

SALTS = 8
STRIP_ROWS = 512  # rows of a batch whose words are counted at once


def _counter(cells: int):
    @arrow_udf("array<double>")
    def vectors(words: pa.Array) -> pa.Array:
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()  # a word is hashed once per batch
        cell = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % cells if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
        place, ends = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
        counts = np.zeros((len(words), cells))
        for s in range(0, len(words), STRIP_ROWS):  # numbers per word are held for a strip of the batch
            own = lengths[s : s + STRIP_ROWS]
            of = cell[place[ends[s] : ends[s + len(own)]]]
            row = np.repeat(np.arange(len(own)), own)
            counts[s : s + len(own)] = np.bincount((row * cells + of)[of >= 0], minlength=len(own) * cells).reshape(len(own), cells)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        np.divide(counts, norm, out=counts, where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * cells), pa.array(counts.ravel()))

    return vectors


def hashed_vector(text: str = "text", cells: int = HASH_CELLS) -> Column:
    """The vector of a text; without words, or null, the zero vector."""
    return _counter(cells)(F.split(F.lower(F.col(text)), WORD_SPLIT))


def sparse_vectors(texts: DataFrame, keys: list[str], text: str = "text", cells: int = HASH_CELLS) -> DataFrame:
    """``(keys..., cell, value)`` of the L2-normalised hashed counts, non-zero cells only."""
    dense = texts.select(*keys, F.posexplode(hashed_vector(text, cells)).alias("cell", "value"))
    return dense.where(F.col("value") != 0).select(*keys, F.col("cell").cast("int").alias("cell"), "value")


def text_vectors(texts: DataFrame, text: str = "text", cells: int = HASH_CELLS, out: str = "embedding") -> DataFrame:
    """``texts`` with a dense ``ARRAY<DOUBLE>`` vector per row; a text without words gets the zero vector."""
    return texts.withColumn(out, hashed_vector(text, cells))


NO_TEXT = "null"  # the hash column's value of a page without text; its vector is the zero vector
PREFIX = 2  # hex digits of a text's hash that name its partition of the store: 256 of them
_STORED = "text_hash string, embedding array<double>, prefix string"


def _hashed(pages: DataFrame, text: str) -> DataFrame:
    return pages.select("input_id", "page_no", F.coalesce(F.md5(F.col(text)), F.lit(NO_TEXT)).alias("text_hash"), F.col(text).alias("text"))


def stored_vectors(spark, folder: str, hashes: DataFrame) -> DataFrame:
    """``(text_hash, embedding, prefix)`` of the store's partitions that ``hashes(text_hash)`` may lie in; the others aren't read."""
    prefixes = [r[0] for r in hashes.select(F.substring("text_hash", 1, PREFIX)).distinct().collect()]  # at most 16^PREFIX and one
    return spark.read.schema(_STORED).parquet(folder).where(F.col("prefix").isin(prefixes))


def embed_missing(pages: DataFrame, store: str, text: str = "text", cells: int = HASH_CELLS, vectoriser=None, name: str = "hashed") -> DataFrame:
    """Vectors ``(input_id, page_no, text_hash, embedding)`` of ``pages`` from a store, a Parquet table
    ``(text_hash, embedding)`` under ``store``, partitioned by the vectoriser's name and the first digits of the hash.

    Texts whose hash the store lacks are vectorised once and appended to it; then all pages read
    their vector from it. Only partitions that the pages' texts can lie in are read, so what a call costs follows its pages, not the
    store. The store has one row per text: an append adds what is missing only, so that one that was broken off, with some of its files
    left, is completed by the next one. Two calls at the same time must not append to the same store.
    A page without text keeps its row, with the vector of an empty text. The join is cut by hash and, as many
    pages may share a text, by a salt of the page number.
    """
    spark = pages.sparkSession
    folder = f"{store.rstrip('/')}/vectoriser={name}"
    spark.createDataFrame([], _STORED).write.mode("append").partitionBy("prefix").parquet(folder)  # a first run finds an empty store
    keyed = _hashed(pages, text)
    have = stored_vectors(spark, folder, keyed)
    texts = keyed.groupBy("text_hash").agg(F.coalesce(F.first("text", ignorenulls=True), F.lit("")).alias("text"))
    fresh = texts.join(have.select("text_hash"), "text_hash", "left_anti")
    vectors = (vectoriser or (lambda t: text_vectors(t, "text", cells)))(fresh)
    new = vectors.select("text_hash", "embedding", F.substring("text_hash", 1, PREFIX).alias("prefix"))
    new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(folder)
    salt = F.pmod(F.col("page_no"), F.lit(SALTS)).cast("int")
    spread = stored_vectors(spark, folder, keyed).drop("prefix").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("_salt", salt).join(spread, ["text_hash", "_salt"]).select("input_id", "page_no", "text_hash", "embedding")

"""Shards by weighted rendezvous hashing of a stable record key.

Every (key, shard) pair has a hash of its own, read as a number u between 0 and 1, and scores ``ln(u) / weight``. A record goes to
the shard of its largest score. So a shard gets records in proportion to its weight, the key and the shards alone decide, and
a change moves only what it has to: a new shard takes records into itself and no record moves between the others, a shard that goes
gives its records to the others in proportion to their weights, and a raised weight only draws records to its shard.

Everything is a column expression over one scan. Slots number the records of a shard from 0 without gaps; they come from a range sort
of the slim rows, without their texts, that cuts a large shard into many tasks.

Odd rows: a null key is a key of its own (one shard holds all such rows), a null text has no bytes, repeated rows are kept as often as they occur
and get slots of their own; rows equal in key, size and text take the slots among them in any order. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

SHARDS = 16
NULL_KEY = "null"
_DIGITS = 13  # hexadecimal digits of the hash that are used: 52 bits, exact as a double


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The score of a shard for a key: ``ln(u) / weight``, u from the md5 of ``key:shard``. Never positive, never infinite."""
    if not weight > 0:
        raise ValueError(f"the weight of shard {shard} must be positive, not {weight}")
    named = F.concat(F.coalesce(key.cast("string"), F.lit(NULL_KEY)), F.lit(f":{shard}"))
    cell = F.conv(F.substring(F.md5(named), 1, _DIGITS), 16, 10).cast("double")
    u = (cell + F.lit(0.5)) / F.lit(float(1 << 4 * _DIGITS))
    return F.ln(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Mapping[int, float] | Sequence[float] | int) -> Column:
    """The shard of a key. ``weights``: a weight per shard name, a list of them for shards 0, 1 ..., or a number of equal shards. Of equal
    scores the smaller shard wins."""
    if isinstance(weights, int):
        weights = [1.0] * weights
    pairs = sorted(weights.items()) if isinstance(weights, Mapping) else list(enumerate(weights))
    if not pairs:
        raise ValueError("there must be a shard")
    ranked = [F.struct(score(key, s, w).alias("score"), F.lit(-int(s)).alias("less")) for s, w in pairs]
    best = ranked[0] if len(ranked) == 1 else F.greatest(*ranked)
    return (-best["less"]).cast("int")


def dealt(rows: DataFrame, key: str = "doc_id", weights: Mapping[int, float] | Sequence[float] | int = SHARDS, out: str = "shard") -> DataFrame:
    """``rows`` with the shard of each; no shuffle."""
    return rows.withColumn(out, shard_of(F.col(key), weights))


def slotted(rows: DataFrame, order: list[str], shard: str = "shard", out: str = "slot") -> DataFrame:
    """``rows`` with their place in their shard, 0, 1 ... in ``order``."""
    return number_rows(rows, shard, order, out=out).withColumn(out, F.col(out).cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` of every row of ``docs(key, text)``: the shard among ``shards`` equal
    ones, the place in it, and the shard if there were one more. ``size`` is the text's bytes and 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(key, (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = dealt(dealt(slim, key, shards, "shard"), key, shards + 1, "grown_shard")
    return slotted(placed, [key, "size", "text_crc32"]).select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Mapping[int, float] | Sequence[float] | int = SHARDS, key: str = "doc_id", rows_per_file: int = 0) -> None:
    """Write ``docs`` as Parquet, a folder per shard, each in order of the key. Rows are dealt by ranges of (shard, key), so several tasks write
    a large shard."""
    ranged = dealt(docs, key, weights).withColumn("_from", F.spark_partition_id()).repartitionByRange("shard", key, "_from").sortWithinPartitions("shard", key).drop("_from")
    writer = ranged.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("shard").parquet(path)

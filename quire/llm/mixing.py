"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash of its id and text. A source that is to give ``target`` words takes each of
its documents ``floor(target / size of the source)`` times, and those below a hash threshold once
more. The threshold comes from histograms: words are summed by source and hash bucket (the hash's
leading bits), the bucket where the running sum crosses the budget is the boundary, and only its
documents are summed again by the next bits, until the boundary holds one hash value. The documents
are then filtered by comparing hashes; nothing is sorted but the bucket sums of a source.

A boundary hash is taken if that brings the sum nearer to the budget. Rows that are equal in id and text share a
hash and go together; ids may be null or repeat. Null texts and texts without words have size 0 and are taken 0 words of; null
sources are one source, last in order; a null id or text hashes like an empty one. With no words at all every target is 0.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import same, stored, word_count

HASH_BITS, STEP_BITS = 60, 12
WEIGHTS, SHARE, CEILING = (3, 1, 2), (3, 2), 2


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id and the text's MD5, as long."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources(source, ...)``, one row each, with the weight of its place by code point, null last."""
    keyed = sources.withColumn("_all", F.lit(0)).withColumn("_key", F.struct(F.col("source").isNull().alias("n"), F.col("source").alias("s")))
    placed = number_rows(keyed, "_all", ["_key"], out="_place")
    pick = F.element_at(F.array(*map(F.lit, weights)), F.col("_place") % len(weights) + 1)
    return placed.withColumn("weight", pick.cast("long")).drop("_all", "_key", "_place")


def with_targets(sources: DataFrame, share: tuple[int, int] = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``: the weights' part of ``share`` of all
    sizes, at most ``ceiling`` times the source's size, what is above that going to the others by
    weight. Each round is one sum over the sources; it ends when no more source is at its ceiling."""
    big = "decimal(38,0)"
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    up, down = share
    capped, held = F.lit(False), -1
    while True:
        row = sources.select(capped.alias("c"), "source_size", "weight").agg(
            F.sum(F.when(F.col("c"), F.col("source_size")).otherwise(0)).alias("size"),
            F.sum(F.when(F.col("c"), 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.col("c").cast("long")).alias("n"),
        ).first()
        left, weight = up * total - down * ceiling * int(row["size"] or 0), down * int(row["weight"] or 0)
        if not weight or row["n"] == held:
            break
        held = row["n"]
        capped = F.col("source_size").cast(big) * Decimal(ceiling * weight) <= F.col("weight").cast(big) * Decimal(left)
    free = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(capped, F.col("source_size").cast("double") * ceiling).otherwise(free))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For ``budgets(source, budget)`` the hash below which the words of ``docs(source, size, h)``
    come nearest to the budget: ``source, bound``."""
    done = None
    open_ = budgets.where(F.col("budget") > 0).select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for shift in range(HASH_BITS, 0, -STEP_BITS):
        d, o = docs.withColumn("_prefix", F.shiftright("h", shift)), open_.withColumnRenamed("source", "_source")
        inside = d.join(o, same(d["source"], o["_source"]) & (d["_prefix"] == o["prefix"]))
        sums = inside.groupBy("source", "budget", "before", F.shiftright("h", shift - STEP_BITS).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = sums.withColumn("upto", F.col("before") + F.sum("words").over(by_bucket)).withColumn("from", F.col("upto") - F.col("words"))
        edge = stored(running.where((F.col("from") <= F.col("budget")) & (F.col("budget") < F.col("upto"))))
        one = F.col("low") == F.col("high")
        nearer = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("from")
        found = edge.where(one).select("source", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("bound"))
        done = found if done is None else done.unionByName(found)
        open_ = edge.where(~one).select("source", "budget", F.col("bucket").alias("prefix"), F.col("from").alias("before"))
        if open_.isEmpty():
            break
    return done


def with_size(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, word_count(F.col("text")).alias("_size"), row_hash(F.col("doc_id"), F.col("text")).alias("_h"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Per source of ``docs(source, _size, _h)``: ``source, source_size, target, base, bound``."""
    sizes = stored(docs.groupBy("source").agg(F.sum("_size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = stored(with_targets(stored(weighted(sizes, weights)), share, ceiling).withColumn("base", whole.cast("long")))
    budgets = goals.select("source", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"))
    bounds = thresholds(docs.select("source", F.col("_size").alias("size"), F.col("_h").alias("h")), budgets).withColumnRenamed("source", "_source")
    joined = goals.join(bounds, same(F.col("source"), F.col("_source")), "left")
    return stored(joined.select("source", "source_size", "target", "base", F.coalesce("bound", F.lit(0)).alias("bound")))


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs(source, _h, ...)`` with the plan's columns of its source and ``copies``, how often the row is taken."""
    renamed = plan.withColumnRenamed("source", "_of")
    joined = docs.join(renamed, same(docs["source"], renamed["_of"]))
    return joined.withColumn("copies", F.col("base") + (F.col("_h") < F.col("bound")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of each row of ``docs(doc_id, text, source)``."""
    slim = stored(with_size(docs, "doc_id", "source"))
    mixed = with_copies(slim, plan(slim, weights, share, ceiling))
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("_size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns as they are."""
    goals = plan(stored(with_size(docs, "source")), weights, share, ceiling)
    renamed = goals.select(F.col("source").alias("_of"), F.col("base").alias("_base"), F.col("bound").alias("_bound"))
    joined = docs.join(renamed, same(docs["source"], renamed["_of"]))
    copies = F.col("_base") + (row_hash(docs["doc_id"], docs["text"]) < F.col("_bound")).cast("long")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).drop("_copy")

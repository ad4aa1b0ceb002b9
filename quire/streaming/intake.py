"""R1 / S8 intake of arriving inputs. Page files land in the intake folder; each micro-batch adds its pages
to a page table and runs the whole split again for the inputs it touched: text, vectors, labels, topics and
outputs. So an input may come in any number of files, and late pages join their input's documents. The page table
holds each input's pages, of which the latest row of a (input, page) counts, and outputs replace those of their input, so a
replayed micro-batch or a re-delivered file changes nothing.

The page table is cut into buckets by a hash of the input, and a micro-batch reads the buckets of its inputs only, by their folders, so
that what it costs follows what arrived, not what has ever been stored.

Pages without an input or a page number go to the reject table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = ("pages", "rejected", "documents", "outputs")
BUCKETS = 1024


def input_bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("input_id"), F.lit(buckets)).cast("int")


def stored_pages(session: SparkSession, folder: str, schema: str, touched: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The stored pages of the ``touched(input_id)`` inputs, from the folders of their buckets; no other folder is listed."""
    wanted = sorted(r[0] for r in touched.select(input_bucket(buckets)).distinct().collect())  # at most ``buckets`` numbers
    paths = [f"{folder}/bucket={b}" for b in wanted]
    return session.read.schema(schema).option("basePath", folder).parquet(*paths).join(touched, "input_id", "left_semi")


def start_intake(
    spark: SparkSession,
    intake_dir: str,
    schema,
    out_dir: str,
    checkpoint: str,
    max_files_per_trigger: int = 16,
    available_now: bool = True,
    buckets: int = BUCKETS,
    **options,
):
    """Start the intake stream; page rows ``(input_id, page_no, text and / or embedding, ...)`` in Parquet. Under ``out_dir``:
    ``pages``, ``rejected``, ``documents`` (document rows per input) and ``outputs`` (as ``write_documents``).
    ``options``: as of ``split_with_pages``."""
    from ..plans.split import named_pages, split_with_pages
    from ..session import cut_lineage
    from ..sinks.outputs import write_documents

    pages_dir, rejected_dir, documents_dir, outputs_dir = (f"{out_dir.rstrip('/')}/{p}" for p in PARTS)
    columns = [f.name for f in schema.fields]
    stored = "bucket int, epoch long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        good, bad = named_pages(batch)  # the intake's files are read again for each use
        # an epoch's rows are a partition of their own, which a replay overwrites
        dealt = good.withColumn("bucket", input_bucket(buckets)).repartition("bucket", F.pmod("page_no", F.lit(8)))  # few files per bucket, a hot input in several
        for rows, folder, parts in ((dealt, pages_dir, ("bucket", "epoch")), (bad, rejected_dir, ("epoch",))):
            rows.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(folder)
        touched = good.select("input_id").distinct()
        if touched.isEmpty():
            return
        known = stored_pages(session, pages_dir, stored, touched, buckets)
        latest = F.row_number().over(Window.partitionBy("input_id", "page_no").orderBy(F.col("epoch").desc(), F.xxhash64(*columns)))
        pages = cut_lineage(known.withColumn("_nth", latest).where(F.col("_nth") == 1).select(*columns))
        docs, doc_pages = split_with_pages(pages, **options)
        docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("input_id").parquet(documents_dir)
        if "text" in columns:
            write_documents(doc_pages, docs, outputs_dir)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(intake_dir)
    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()

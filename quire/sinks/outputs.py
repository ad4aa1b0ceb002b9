"""Sinks: S5 reset of stored results, S6 outputs by document, S7 output manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DOCUMENT_NAME_FORMAT
from ..operators.documents import with_pages


def output_names(named_docs: DataFrame) -> DataFrame:
    """``document_{n}_{topic}`` per document, ranked the way a plain string sort lists them
    (so ``document_10_...`` comes before ``document_2_...``)."""
    from pyspark.sql import Window

    from ..operators.numbering import number_rows

    names = named_docs.select("input_id", "document_no", F.format_string(DOCUMENT_NAME_FORMAT, "document_no", "topic_name").alias("name"))
    return number_rows(names, "input_id", ["name", "document_no"], out="position")


OUTPUT_SCHEMA = "document_no int, page_no int, text string, name string, input_id string"


def _write(rows: DataFrame, path: str, max_records_per_file: int) -> None:
    w = (
        rows.repartitionByRange("input_id", "document_no", "page_no")
        .sortWithinPartitions("input_id", "document_no", "page_no")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
    )
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.partitionBy("input_id").parquet(path)


def _emptied(inputs: DataFrame) -> DataFrame:
    """A row per input that holds no page: written alone it leaves an input without documents."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("document_no", "int"), ("page_no", "int"), ("text", "string"), ("name", "string"))]
    return inputs.select("input_id").distinct().select(*none, "input_id")


def write_documents(doc_pages: DataFrame, named_docs: DataFrame, path: str, max_records_per_file: int = 0, inputs: DataFrame | None = None) -> None:
    """S5 + S6: write every document under its ``input_id=`` partition, one row per page
    ``(document_no, page_no, text, name)`` sorted by document and page. A document of any size is written by its
    pages, never concatenated into one value, and rows are dealt by ranges of (input, document, page), so a large
    document is written by several tasks.

    Dynamic partition overwrite replaces an input's outputs as a whole: those of an earlier run go, also if it had more documents.
    ``inputs``: further inputs whose outputs are to be replaced even if they have no document now. Writing is
    idempotent, so a retried task or a re-run gives the same outputs. Read them with ``read_documents``.
    """
    # names go to page numbers first, so that no text is shuffled to meet its document's name
    names = doc_pages.select("input_id", "document_no", "page_no").distinct().join(named_docs.select("input_id", "document_no", "topic_name"), ["input_id", "document_no"])
    out = with_pages(doc_pages, names).select("document_no", "page_no", "text", F.format_string(DOCUMENT_NAME_FORMAT, "document_no", "topic_name").alias("name"), "input_id")
    if inputs is not None:
        out = out.unionByName(_emptied(inputs))
    _write(out, path, max_records_per_file)


def read_documents(spark, path: str) -> DataFrame:
    """The pages of all stored documents."""
    return spark.read.schema(OUTPUT_SCHEMA).parquet(path).where(F.col("document_no").isNotNull())


def reset_outputs(path: str, inputs: DataFrame) -> None:
    """Drop the stored outputs of the given inputs; other inputs' outputs stay. Each partition is overwritten by
    one row without a page, so Spark's own names of partitions are used, whatever characters an id has."""
    _write(_emptied(inputs), path, 0)

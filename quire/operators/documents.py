"""Documents from page labels (A5, W3), their pages and texts (J3, J4, W4, W5, A6, A7),
page requests (J6) and the run summary (A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DOCUMENT_NAME_FORMAT, SAMPLE_SEED, TOPIC_SAMPLE_PAGES
from .numbering import number_rows


def documents_from_labels(labels: DataFrame) -> DataFrame:
    """A5 + W3: one row per cluster, numbered 0..k-1 by first page.

    ``(input_id, document_no, label, document_id, topic_name, page_start, page_end, n_pages)``.
    ``document_id`` is md5(input_id:page_start), stable across re-runs. Page membership stays in
    ``document_pages`` rows rather than an array, so a huge document is never one value.
    """
    from ..session import cut_lineage

    docs = labels.groupBy("input_id", "label").agg(
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.count(F.lit(1)).cast("int").alias("n_pages")
    )
    # one row per document: written once, since numbering reads it twice and the labels
    # upstream may come from a Python task
    docs = number_rows(cut_lineage(docs), "input_id", ["page_start"], out="document_no")
    return docs.select(
        "input_id",
        "document_no",
        "label",
        F.md5(F.concat_ws(":", "input_id", F.col("page_start").cast("string"))).alias("document_id"),
        F.format_string("Cluster %d", "document_no").alias("topic_name"),
        "page_start",
        "page_end",
        "n_pages",
    )


def document_pages(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(input_id, document_no, page_no) by an equi-join on (input_id, label)."""
    return labels.join(docs.select("input_id", "label", "document_no"), ["input_id", "label"]).select("input_id", "document_no", "page_no")


def page_texts(doc_pages: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """The text of every document page, joined by key (never by position)."""
    return doc_pages.join(texts.select("input_id", "page_no", F.col(text).alias("text")), ["input_id", "page_no"])


def first_pages(doc_pages: DataFrame) -> DataFrame:
    """``(input_id, document_no, page_no)`` of the lowest page of each document. Written once: with the size of its files known, the few rows are sent
    to the texts, and no text is shuffled to meet its document."""
    from ..session import cut_lineage

    return cut_lineage(doc_pages.groupBy("input_id", "document_no").agg(F.min("page_no").alias("page_no")))


def first_page_text(doc_text: DataFrame) -> DataFrame:
    """Text of the lowest page of each document. The lowest pages are found without their texts, and the texts of others are dropped by
    ``with_pages`` before the documents' rows meet."""
    first = doc_text.groupBy("input_id", "document_no").agg(F.min("page_no").alias("page_no"))
    return with_pages(doc_text, first).groupBy("input_id", "document_no").agg(F.min_by("text", "page_no").alias("text"))


def with_pages(doc_text: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc_text`` joined with ``rows(input_id, document_no, page_no, ...)``. The join is by input and page, as texts were joined with their pages, so texts that
    have just been so stay where they are and only ``rows`` move; that the documents are equal is looked at afterwards."""
    other = rows.withColumnRenamed("document_no", "_document")
    return doc_text.join(other, ["input_id", "page_no"]).where(F.col("document_no") - F.col("_document") == 0).drop("_document")


def sample_pages(doc_text: DataFrame, k: int = TOPIC_SAMPLE_PAGES, seed: str = SAMPLE_SEED) -> DataFrame:
    """Up to ``k`` pages per document in a seeded pseudo-random order, joined by a space in
    that order. ``row_number() <= k`` is planned as a group limit, cut before the shuffle."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "input_id", F.col("page_no").cast("string")))
    w = Window.partitionBy("input_id", "document_no").orderBy(key, "page_no")
    picked = doc_text.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return picked.groupBy("input_id", "document_no").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY _rk)").alias("text"), F.count(F.lit(1)).cast("int").alias("n_sampled")
    )


def concat_in_order(df: DataFrame, keys: list[str], sep: str, text: str = "text", order: str = "page_no") -> DataFrame:
    """Ordered text concatenation per group."""
    sep_sql = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return df.groupBy(*keys).agg(F.expr(f"listagg({text}, '{sep_sql}') WITHIN GROUP (ORDER BY {order})").alias("text"))


def reassemble(doc_text: DataFrame) -> DataFrame:
    """Each document's pages in order as one output body (pages separated by a line break)."""
    return concat_in_order(doc_text, ["input_id", "document_no"], "\n")


def missing_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested (input_id, page_no) rows that the input does not have."""
    return requests.join(pages.select("input_id", "page_no"), ["input_id", "page_no"], "left_anti")


def split_summary(docs: DataFrame) -> DataFrame:
    """A line per document with its name and page range, beside its input's number of documents and pages."""
    per_input = docs.groupBy("input_id").agg(F.count(F.lit(1)).cast("int").alias("documents"), F.sum("n_pages").cast("bigint").alias("pages"))
    lines = docs.select(
        "input_id",
        "document_no",
        F.format_string(DOCUMENT_NAME_FORMAT, "document_no", "topic_name").alias("name"),
        F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")).alias("pages_from_to"),
    )
    return lines.join(per_input, "input_id")

"""End-to-end split of page streams into named documents (the library entry point).

pages -> [text -> vectors] -> labels (clustering | boundary detection) -> [gap split]
      -> documents -> topics -> names -> outputs
Every arrow is a DataFrame -> DataFrame function; all shuffles are keyed by input_id or finer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_ALPHA, DEFAULT_LINKAGE, DEFAULT_THRESHOLD, SPLIT_LEVEL_MAX, SPLIT_LEVEL_MIN
from ..operators import documents as D
from ..operators.cluster import cluster_pages
from ..operators.segment import boundary_detection, gap_split
from ..operators.topics import assign_topics, tfidf_topics
from ..operators.vectorize import text_vectors
from ..session import cut_lineage

METHODS = ("cluster", "boundary")


def split_level(level: float) -> float:
    """A split level of the user's scale, which is the clustering threshold; out of its range it is rejected."""
    if not SPLIT_LEVEL_MIN <= float(level) <= SPLIT_LEVEL_MAX:
        raise ValueError(f"split level {level} is not in {SPLIT_LEVEL_MIN} .. {SPLIT_LEVEL_MAX}")
    return float(level)


def page_labels(
    pages: DataFrame,
    method: str = "cluster",
    alpha: float = DEFAULT_ALPHA,
    threshold: float | None = None,
    linkage: str = DEFAULT_LINKAGE,
    gap: int | None = None,
    spread: bool = True,
    matrix: Callable | None = None,
    distance: Callable | None = None,
) -> DataFrame:
    """Labels by either method. ``threshold`` None is the method's own default (2.0 for clusters, 0.4 for boundaries)."""
    if method == "cluster":
        labels = cluster_pages(pages, alpha, DEFAULT_THRESHOLD if threshold is None else threshold, linkage, spread=spread, matrix=matrix, distance=distance)
    elif method == "boundary":
        labels = boundary_detection(pages, threshold, spread=spread)
    else:
        raise ValueError(f"unknown method: {method}")
    return gap_split(labels, gap) if gap is not None else labels


def named_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with an input and a page number, and the others, which no document can hold."""
    whole = F.col("input_id").isNotNull() & F.col("page_no").isNotNull()
    return pages.where(whole), pages.where(~whole)


def split_with_pages(
    pages: DataFrame,
    method: str = "cluster",
    alpha: float = DEFAULT_ALPHA,
    threshold: float | None = None,
    linkage: str = DEFAULT_LINKAGE,
    gap: int | None = None,
    strategy: str = "first_page",
    vectoriser: Callable[[DataFrame], DataFrame] = text_vectors,
    namer: Callable[[DataFrame], DataFrame] = tfidf_topics,
    spread: bool = True,
    matrix: Callable | None = None,
    distance: Callable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Named documents, and their pages ``(input_id, document_no, page_no[, text])``. ``matrix`` and ``distance`` as of ``cluster_pages``."""
    pages, _ = named_pages(pages)
    vectors = pages
    if "embedding" not in pages.columns:
        vectors = cut_lineage(vectoriser(pages.select("input_id", "page_no", "text")))
    # labels feed the documents, their pages and their texts: write them once
    labels = cut_lineage(page_labels(vectors, method, alpha, threshold, linkage, gap, spread, matrix, distance))
    docs = D.documents_from_labels(labels)
    doc_pages = D.document_pages(labels, docs)
    if "text" in pages.columns:
        doc_pages = D.page_texts(doc_pages, pages)
        docs = assign_topics(docs, doc_pages, strategy, namer)
    # written once: the namer may be a model, and its results go to names, outputs and reports
    return cut_lineage(docs.drop("label")), doc_pages


def split_pages(pages: DataFrame, **options) -> DataFrame:
    """Documents of every input ``(input_id, document_no, document_id, topic_name, page_start,
    page_end, n_pages)``. ``pages`` needs ``embedding``; with a ``text`` column the documents are
    named by topic, otherwise they keep ``Cluster n``. Without ``embedding`` but with ``text``,
    the vectors are computed first, by ``vectoriser``. A namer that reports failures adds ``topic_error``. Options as of ``split_with_pages``."""
    return split_with_pages(pages, **options)[0]


def run_split(pages: DataFrame, path: str, **options) -> DataFrame:
    """The whole run: split, name, replace the inputs' outputs under ``path`` by their new ones, and return the manifest."""
    from ..sinks.outputs import output_names, write_documents

    docs, doc_pages = split_with_pages(pages, **options)
    if "text" not in doc_pages.columns:
        doc_pages = doc_pages.withColumn("text", F.lit(None).cast("string"))
    write_documents(doc_pages, docs, path, inputs=named_pages(pages)[0].select("input_id").distinct())
    return output_names(docs)

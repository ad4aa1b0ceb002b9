"""T1 document topics and T2 topic assignment with fallback.

The default namer takes the two highest TF-IDF words of the chosen text of each document,
against all documents of the same input, joined by ``_`` (the 1-2 word style of the names the
splitter asks for). Any DataFrame -> DataFrame namer with columns
``(input_id, document_no, topic)`` can be passed instead; ``model_namer`` makes one from a Python function, and a document that the function
fails on keeps its default name and is reported, while all others are named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explode_words
from ..session import cut_lineage
from .documents import first_page_text, sample_pages

STRATEGIES = ("first_page", "random_sample")
TOPIC_WORDS = 2


def tfidf_topics(doc_text: DataFrame, k: int = TOPIC_WORDS) -> DataFrame:
    """``(input_id, document_no, topic)`` from one text per document.

    score = tf * (ln((1 + N) / (1 + df)) + 1), rounded to 9 places; ties by word.
    Only words of more than one letter count (the short-segment rule).
    """
    w = explode_words(doc_text, ["input_id", "document_no"], "text", "word").where(F.length("word") > 1)
    tf = cut_lineage(w.groupBy("input_id", "document_no", "word").agg(F.count(F.lit(1)).alias("tf")))  # texts are cut into words once, for both counts
    df_ = tf.groupBy("input_id", "word").agg(F.count(F.lit(1)).alias("df"))
    n_docs = doc_text.groupBy("input_id").agg(F.count(F.lit(1)).alias("n_docs"))
    scored = tf.join(df_, ["input_id", "word"]).join(n_docs, "input_id").select(
        "input_id",
        "document_no",
        "word",
        F.round(F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0), 9).alias("score"),
    )
    rk = Window.partitionBy("input_id", "document_no").orderBy(F.col("score").desc(), F.col("word"))
    top = scored.withColumn("_rk", F.row_number().over(rk)).where(F.col("_rk") <= k)
    return top.groupBy("input_id", "document_no").agg(F.expr("listagg(word, '_') WITHIN GROUP (ORDER BY _rk)").alias("topic"))


NAMED = "input_id string, document_no int, topic string, topic_error string"
ERROR_CHARS = 500
BATCH_DOCUMENTS = 32


def model_namer(name: Callable[[list[str]], list[str | None]], batch: int = BATCH_DOCUMENTS) -> Callable[[DataFrame], DataFrame]:
    """A namer from ``name(texts) -> topics``, which may call a model; it gets ``batch`` texts at a time. If it raises, or gives another
    number of topics, the batch's documents are given to it one by one, and those it still fails on get no topic but
    a ``topic_error``. A topic that is null or blank, or a null text, leaves the document unnamed without an error."""

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            found = name([text])
            if len(found) != 1:
                raise ValueError(f"1 topic expected, {len(found)} given")
            return found[0], None
        except Exception as e:  # whatever a model raises concerns its document only
            return None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]

    def named(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = list(name(texts))
            if len(found) == len(texts):
                return [(t, None) for t in found]
        except Exception:
            pass  # found out one by one which document it is
        return [one(t) for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                known = part["text"].notna().to_numpy()
                results = iter(named(part["text"][known].tolist()) if known.any() else [])
                pairs = [next(results) if k else (None, None) for k in known]
                topics = [str(t).strip() or None if t is not None else None for t, _ in pairs]
                yield pd.DataFrame({"input_id": part["input_id"].to_numpy(), "document_no": part["document_no"].to_numpy(), "topic": topics, "topic_error": [e for _, e in pairs]})

    return lambda chosen: chosen.select("input_id", "document_no", "text").mapInPandas(run, NAMED)


def assign_topics(docs: DataFrame, doc_text: DataFrame, strategy: str = "first_page", namer=tfidf_topics) -> DataFrame:
    """Replace the default ``Cluster n`` name by the topic of the chosen text; documents the
    namer gives nothing for, or fails on, keep their default name. A namer that reports failures (``model_namer``) adds their
    ``topic_error`` to the documents. Unknown strategies are rejected up front."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such topic strategy: {strategy!r}; there are {STRATEGIES}")
    chosen = first_page_text(doc_text) if strategy == "first_page" else sample_pages(doc_text).drop("n_sampled")
    named = namer(chosen)
    return docs.join(named, ["input_id", "document_no"], "left").withColumn(
        "topic_name", F.coalesce(F.col("topic"), F.col("topic_name"))
    ).drop("topic")

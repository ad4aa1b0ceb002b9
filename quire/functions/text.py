"""Text and name functions as column expressions (P2, P3, P4, word split)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PAGE_FILE_SUFFIXES

# Patterns of the markup-to-text step, applied in this order, each match replaced by one space.
SCRIPT_STYLE_COMMENT = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
TAG = r"<[^>]*>"
BLANKS = r"\s+"
WORD_SPLIT = r"[^\p{L}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def html_to_text(c) -> Column:
    """Drop script/style blocks and comments, then tags, collapse blanks, trim."""
    t = F.regexp_replace(_c(c), SCRIPT_STYLE_COMMENT, " ")
    t = F.regexp_replace(t, TAG, " ")
    t = F.regexp_replace(t, BLANKS, " ")
    return F.trim(t)


def explode_words(df, keys: list[str], c: str = "text", out: str = "word"):
    """One row per word of every text (whole texts). Explode first, then filter: a plain
    predicate stays in whole-stage codegen, a lambda over the array would not."""
    return df.select(*keys, F.explode(F.split(F.lower(F.col(c)), WORD_SPLIT)).alias(out)).where(F.length(out) > 0)


def long_segments(c, sep: str = "\n") -> Column:
    """The segments of a text longer than one character."""
    return F.filter(F.split(_c(c), sep), lambda s: F.length(s) > 1)


def file_stem(path) -> Column:
    """Base name without directory and extension."""
    base = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def text_file_name(path) -> Column:
    """Page file name with ``.pdf`` replaced by ``.txt``."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.pdf$", ".txt")


def vectors_file_name(path) -> Column:
    """``{stem}_embeddings`` store name of an input."""
    return F.concat(file_stem(path), F.lit("_embeddings"))


def has_page_suffix(path) -> Column:
    """S2 predicate: case-sensitive ``.pdf`` / ``.jpg`` / ``.png`` suffix."""
    cond = None
    for s in PAGE_FILE_SUFFIXES:
        e = _c(path).endswith(s)
        cond = e if cond is None else cond | e
    return cond

"""WARC derivatives: metadata and plain-text conversion records of web responses.

``responses`` makes a WARC response record of each page (HTTP header, body, digests). ``derivatives``
turns responses into two linked records each: a ``metadata`` record (JSON of title, declared language,
links, the source's headers and sizes) and a ``conversion`` record (the page's plain text). Both
keep the target address and date, point to the response with ``WARC-Refers-To``, and carry the source's
payload digest beside a digest of their own block. The conversion record also names its metadata record in
``WARC-Concurrent-To``. ``write_records`` writes any of them as WARC files.

Record ids are URNs from the MD5 of kind, page id, address and payload digest, so reruns agree and rows that are
repeated get equal ids. Digests are ``sha1:`` and the hex SHA-1. Rows with a null body have an
empty payload, a null address becomes an empty one and a null page id an empty string in the id. Line breaks in an
address are removed, as they would end its header. An empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

#: Parts that hold no text, and white space; (?s) lets . match line breaks.
NO_TEXT = r"(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|[ \t\n\x0B\f\r]+"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header|body|html|blockquote|pre)\b[^>]*>"
TAG = r"(?s)<[^>]*>"
#: Entities, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANG = r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)"
#: An anchor's address: quoted or not, with white space around the sign or not.
LINK = r"(?i)<a[ \t\n\x0B\f\r](?:[^>]*?[ \t\n\x0B\f\r\"'])?href[ \t\n\x0B\f\r]*=[ \t\n\x0B\f\r]*(\"[^\">]*\"|'[^'>]*'|[^ \t\n\x0B\f\r\"'>]+)"


def plain_text(html: Column) -> Column:
    """A page's text: a line per block, blanks joined, empty lines dropped."""
    out = F.regexp_replace(html, NO_TEXT, " ")
    out = F.regexp_replace(out, BREAKS, "\n")
    out = F.regexp_replace(out, TAG, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r" *\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(out, r"  +", " "), F.lit(" \n"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(block, "UTF-8")))


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _json(text: Column) -> Column:
    """A JSON string."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), F.regexp_replace(out, r"[\x00-\x1F]", " "), F.lit('"'))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id, record_id, target_uri, date, http_header, payload, payload_digest, block_digest,
    content_length`` of a response record for each row of ``pages(page_id, url, html)``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("target_uri"), F.lit(date).alias("date"), payload.alias("payload"))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    based = base.select("*", header.alias("http_header"), digest(F.col("payload")).alias("payload_digest"))
    block = F.concat("http_header", "payload")
    return based.select(
        "page_id", record_id("response", F.col("page_id"), F.col("target_uri"), F.col("payload_digest")).alias("record_id"), "target_uri", "date", "http_header", "payload", "payload_digest",
        digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response: ``page_id, record_type, record_id, refers_to, concurrent_to, target_uri, date,
    source_digest, block_digest, content_type, content_length, block``."""
    html = F.col("payload")
    seen = records.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_header", F.col("payload_digest").alias("source_digest"), F.col("content_length").alias("source_length"),
        F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"[ \t\n\x0B\f\r]+", " ").alias("title"),
        F.lower(F.regexp_extract(html, LANG, 1)).alias("lang"),
        F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("links"),
        plain_text(html).alias("text"),
    )
    ids = lambda kind: record_id(kind, F.col("page_id"), F.col("target_uri"), F.col("source_digest"))
    links = F.concat(F.lit("["), F.concat_ws(",", F.transform("links", lambda x: _json(F.when(x.rlike("^[\"']"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)))), F.lit("]"))
    fields = [("refers-to", _json(F.col("refers_to"))), ("uri", _json(F.col("target_uri"))), ("title", _json(F.col("title"))), ("lang", _json(F.col("lang"))), ("source-headers", _json(F.col("http_header"))),
              ("source-digest", _json(F.col("source_digest"))), ("source-length", F.col("source_length").cast("string")), ("text-digest", _json(digest(F.col("text")))), ("links", links)]
    metadata = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields]), F.lit("}"))
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), ids("metadata").alias("record_id"), F.lit("").alias("concurrent_to"), F.lit("application/json").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), ids("conversion").alias("record_id"), ids("metadata").alias("concurrent_to"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    made = seen.select("page_id", "refers_to", "target_uri", "date", "source_digest", F.inline(both))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "source_digest", digest(F.col("block")).alias("block_digest"), "content_type",
        F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def record_text(records: DataFrame) -> DataFrame:
    """A column ``value`` with the whole WARC record of each derived record, without the two line breaks that end it."""
    line = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Concurrent-To", F.col("concurrent_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.col("source_digest")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )
    return records.select(F.concat(header, F.col("block")).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """WARC files of the derived records, one per partition; Spark's text writer ends each record."""
    record_text(records).write.option("lineSep", CRLF + CRLF).text(path)

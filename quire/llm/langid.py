"""Language of web pages by Bayesian fusion of four kinds of evidence.

* text: letter n-gram likelihoods, learned from ``documents`` with a known language (a bounded sample,
  the first ``FIT_ROWS`` per language by a hash of id and text, whole texts up to ``FIT_BYTES`` bytes; of a language
  that has only longer ones, their first ``FIT_BYTES`` characters);
* declared markup language, and the language-like first part of the address' path: how often pages of a language have which;
* address suffix and host: a prior from the other pages of the host, smoothed towards its registered domain, that towards
  its suffix, and that towards all pages. The suffix enters here, and only here.

The counts behind the last two come from all pages by grouped aggregation, each page counting by its
text's own posterior, so declarations that are wrong as a rule weigh little. A page's own share is taken
out of all counts it meets, so a value that only this page has says nothing: smoothing adds to a value's counts in proportion to the languages'
sizes. Every declared code, path part, suffix and host has a count of its own: they are summed in
the tasks first, and joined back by value. Numeric hosts have no suffix and are their own domain. The registered domain is the last two
labels, or three where a country's suffix follows one of the ``SECOND_LEVEL`` labels.

The text's log-likelihood is divided by the square root of its length, as neighbouring n-grams
aren't independent. Pages without text rely on the other evidence; null address and markup give none. Ties go
to the first language in alphabetical order. Repeated rows are judged each; an empty table gives no rows.
Without documents of a known language there are no classes, and the result is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, same, stored
from .warc import LANG, plain_text

FIT_ROWS, FIT_BYTES, CELLS, SMOOTH = 400, 20_000, 1 << 15, 5.0
VALUE_SMOOTH, PLACES = 1.0, 1 << 40  # added counts of a value, over all languages; places of the sample's hash
# Labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "info", "mil", "ne", "net", "nom", "or", "org")


def cells(text: str) -> np.ndarray:
    """Hash cells of the letter trigrams of a text, in lower case, other characters as blanks."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    points = np.array([ord(c) for c in f" {' '.join(letters.split())} "], np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(CELLS)).astype(np.int64)


def fit_text(docs: DataFrame, rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and the log-probability of each cell in each."""
    from pyspark.sql import Window

    long = F.octet_length("text") > max_bytes
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", place.alias("h"), long.alias("long"))
    # places are picked before texts move: of each language about four times as many rows as wanted have a place below its bound, whatever
    # its size, and the first of those are the first of all
    keys = known.select("lang", "long", "h")
    bounds = keys.groupBy("lang", "long").agg(F.count("*").alias("n")).select(F.col("lang").alias("_l"), F.col("long").alias("_g"), (F.lit(4.0 * rows * PLACES) / F.col("n")).alias("bound"))
    likely = keys.join(bounds, (F.col("lang") == F.col("_l")) & (F.col("long") == F.col("_g"))).where(F.col("h") <= F.col("bound")).select("lang", "long", "h")
    first = likely.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))).where(F.col("_rank") <= rows)
    picked = stored(first.select("lang", "long", "h").distinct())
    texts = known.select("lang", "long", "h", F.when(F.col("long"), F.substring("text", 1, max_bytes)).otherwise(F.col("text")).alias("text"))
    sample = texts.join(picked, ["lang", "long", "h"], "left_semi").dropDuplicates(["lang", "h"]).collect()
    short = {r["lang"] for r in sample if not r["long"]}
    sample = [r for r in sample if not r["long"] or r["lang"] not in short]
    langs = sorted({r["lang"] for r in sample})
    counts = np.full((len(langs), CELLS), 0.1)
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"])):
        counts[langs.index(r["lang"])] += np.bincount(cells(r["text"]), minlength=CELLS)
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``page_id, host, domain, suffix, path, declared, text_log`` (an array, by language) of each page."""
    ready(pages.sparkSession)
    compact = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                c = cells(text.as_py() or "")
                out.append((compact[:, c].sum(1, dtype=np.float64) / np.sqrt(max(1, len(c)))).tolist())
            keep = [batch.column(n) for n in ("page_id", "host", "domain", "suffix", "path", "declared")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "path", "declared", "text_log"])

    url, none = F.lower(F.coalesce("url", F.lit(""))), F.lit("")
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    first_path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", none), LANG, 1))
    numeric = host.rlike(r"^[0-9]+(\.[0-9]+)*$")
    under = F.regexp_extract(host, rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    domain = F.when(numeric, host).when(under != "", under).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
    suffix = F.when(numeric, none).otherwise(F.regexp_extract(host, r"\.([^.]+)$", 1))
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"),
        first_path.alias("path"), F.regexp_extract(declared, r"^([a-z]+)", 1).alias("declared"), plain_text(F.coalesce("html", none)).alias("text"),
    )
    return parts.mapInArrow(run, "page_id long, host string, domain string, suffix string, path string, declared string, text_log array<double>")


def posterior(logs: Column, n: int) -> Column:
    """Probabilities of an array of logs; computed from differences to the largest."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Sums of the pages' probabilities by language, as an array."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("text_p")[i]) for i in range(n)]).alias(name))


def value_logs(count: str, total: list[float]) -> Column:
    """The log-likelihood of a value in each language, from its ``count`` without the page's own share; null where no page has it."""
    whole = F.array(*[F.lit(t) for t in total])
    rest = F.zip_with(whole, F.col("text_p"), lambda t, p: F.greatest(t - p, F.lit(0.0)) + 0.5)
    size = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
    own = F.zip_with(F.col(count), F.col("text_p"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
    return F.zip_with(own, rest, lambda c, t: F.log(c / t + VALUE_SMOOTH / size))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, host`` of every row of ``pages(page_id, url, html)``."""
    ready(pages.sparkSession)
    langs, table = fit_text(docs)
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    rows = stored(evidence(pages, langs, table).withColumn("text_p", posterior(F.col("text_log"), n)))
    total = rows.agg(*[F.sum(F.col("text_p")[i]).alias(f"t{i}") for i in range(n)]).first()
    total = [float(x or 0) for x in total]
    hosts = stored(_sums(rows, ["suffix", "domain", "host"], n, "host_n"))
    domains = hosts.groupBy("suffix", "domain").agg(F.array(*[F.sum(F.col("host_n")[i]) for i in range(n)]).alias("domain_n"))
    suffixes = domains.groupBy("suffix").agg(F.array(*[F.sum(F.col("domain_n")[i]) for i in range(n)]).alias("suffix_n"))
    counts = domains.join(suffixes, "suffix").join(hosts, ["suffix", "domain"])
    counts = stored(counts.select(F.col("suffix").alias("_s"), F.col("host").alias("_h"), "host_n", "domain_n", "suffix_n"))
    joined = rows.join(counts, same(rows["host"], counts["_h"]) & (rows["suffix"] == counts["_s"]))
    for column in ("declared", "path"):
        sums = stored(_sums(rows.where(F.col(column) != ""), [column], n, f"_n_{column}"))
        joined = joined.join(sums.withColumnRenamed(column, f"_v_{column}"), F.col(column) == F.col(f"_v_{column}"), "left")
    said = lambda c: F.coalesce(value_logs(f"_n_{c}", total), F.array(*[F.lit(0.0)] * n))
    whole = F.array(*[F.lit((t + 1) / (sum(total) + n)) for t in total])

    def smoothed(count: str, above: Column) -> Column:
        own = F.zip_with(F.col(count), F.col("text_p"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
        size = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own, above, lambda c, a: (c + SMOOTH * a) / (size + SMOOTH))

    a = joined.withColumn("_suffix_p", smoothed("suffix_n", whole))
    a = a.withColumn("_domain_p", smoothed("domain_n", F.col("_suffix_p")))
    a = a.withColumn("_host_p", smoothed("host_n", F.col("_domain_p")))
    a = a.withColumn("_declared", said("declared")).withColumn("_path", said("path"))
    logs = F.array(*[F.col("text_log")[i] + F.log(F.col("_host_p")[i]) + F.col("_declared")[i] + F.col("_path")[i] for i in range(n)])
    fused = a.withColumn("_logs", logs).withColumn("_p", posterior(F.col("_logs"), n))
    names = F.array(*map(F.lit, langs))
    best = lambda p: F.element_at(names, F.array_position(F.col(p), F.array_max(p)).cast("int"))
    return fused.select("page_id", best("_p").alias("lang"), F.array_max("_p").alias("probability"), best("text_p").alias("text_lang"), "declared", "host")

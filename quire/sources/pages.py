"""Page-level sources: S1 page explode, S2 suffix-filtered file scan, S3 whole-text page scan,
S9 missing-input check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PAGE_FILE_SUFFIXES, PAGE_NAME_FORMAT


def explode_pages(long_texts: DataFrame, lines_per_page: int) -> DataFrame:
    """One long input ``(input_id, stem, text)`` -> one row per page of ``lines_per_page``
    lines: ``(input_id, page_no, page_name, n_lines, text)``, page_no 0-based, name 1-based. Pages are cut within
    the row, without a shuffle."""
    k = int(lines_per_page)
    lines = long_texts.select("input_id", "stem", F.split("text", "\n", -1).alias("_lines"))
    last = F.floor((F.size("_lines") - 1) / k).cast("int")

    def page(p):
        own = F.slice("_lines", p * k + 1, k)
        return F.struct(p.alias("page_no"), F.size(own).alias("n_lines"), F.array_join(own, "\n").alias("text"))

    paged = lines.select("input_id", "stem", F.explode(F.transform(F.sequence(F.lit(0), last), page)).alias("p"))
    name = F.format_string(PAGE_NAME_FORMAT + ".pdf", F.col("stem"), F.col("p.page_no") + 1)
    return paged.select("input_id", "p.page_no", name.alias("page_name"), "p.n_lines", "p.text")


def scan_page_files(spark: SparkSession, path: str, suffixes=PAGE_FILE_SUFFIXES, content: bool = True) -> DataFrame:
    """Files of a directory (or one file) with an accepted suffix, case-sensitive.

    ``(path, name, length[, content])`` through the binaryFile source. The suffixes are a path filter of
    the listing, so other files are never opened; a listing without ``content`` opens none.
    """
    glob = "*{" + ",".join(suffixes) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", glob).load(path)
    cols = ["path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length"]
    return df.select(*cols, "content") if content else df.select(*cols)


PAGE_FOLDER = "page_name"
FILES_PER_TASK = 512


def stage_page_texts(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_name, text)`` as text files, each in a folder ``page_name=<name>``, with Spark's writer. What a file costs hardly depends on
    its bytes, so tasks are cut by the number of files: a given number of partitions isn't merged by their size."""
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // FILES_PER_TASK))
    pages.select("text", F.col("page_name").alias(PAGE_FOLDER)).repartition(tasks, PAGE_FOLDER).write.partitionBy(PAGE_FOLDER).text(path)


def scan_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """S3: every ``*.txt`` under ``path`` as one string per page file.

    ``(input_stem, page_no, text)`` - the page number is parsed from ``..._page_<n>.<ext>``, the name of the file or of
    its ``page_name=`` folder (1-based in the name, 0-based here), so the page order never depends on listing order.
    Files without a page number keep their row, with the whole stem and a null ``page_no``. The line
    break that ends a staged file is not part of its text.
    """
    df = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path, wholetext=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/{PAGE_FOLDER}=([^/]*)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.col("_metadata.file_name"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return df.select(
        F.regexp_replace(stem, r"_page_\d+$", "").alias("input_stem"),
        (F.regexp_extract(stem, r"_page_(\d+)$", 1).try_cast("int") - 1).alias("page_no"),
        F.when(folder != "", F.regexp_replace("value", r"\n\z", "")).otherwise(F.col("value")).alias("text"),
    )


def missing_inputs(requested: DataFrame, available: DataFrame, key: str = "input_id") -> DataFrame:
    """Requested inputs that are absent - checked before any work."""
    return requested.select(key).distinct().join(available.select(key), key, "left_anti")

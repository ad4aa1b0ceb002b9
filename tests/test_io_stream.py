"""Sources, sinks and streams: file scans, document writes with reset, intake idempotence,
online boundaries on shuffled micro-batches equal the batch fold."""

import datetime
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.documents import first_pages, page_texts
from quire.operators.segment import boundary_fold
from quire.operators.vectorize import embed_missing, stored_vectors, text_vectors
from quire.plans.split import named_pages, run_split, split_level, split_pages
from quire.sinks.outputs import output_names, read_documents, reset_outputs, write_documents
from quire.sources.pages import explode_pages, missing_inputs, scan_page_files, scan_page_texts, stage_page_texts
from quire.operators.topics import assign_topics, model_namer, tfidf_topics
from quire.streaming import intake
from quire.streaming.intake import start_intake
from quire.streaming.online import STATE_STORE, online_boundaries


def test_file_scan_suffixes_case_sensitive(spark, scratch):
    for name in ["a.pdf", "b.jpg", "c.png", "d.PDF", "e.txt", "f.pdf.bak"]:
        with open(os.path.join(scratch, name), "wb") as fh:
            fh.write(b"x")
    got = sorted(r.name for r in scan_page_files(spark, scratch).collect())
    assert got == ["a.pdf", "b.jpg", "c.png"]


def test_text_scan_orders_by_page_number_not_listing(spark, scratch):
    for n in [1, 2, 10, 11]:
        with open(os.path.join(scratch, f"in_page_{n}.txt"), "w") as fh:
            fh.write(f"text {n}\nline two")
    got = sorted((r.page_no, r.text) for r in scan_page_texts(spark, scratch).collect())
    assert [p for p, _ in got] == [0, 1, 9, 10]
    assert got[2][1] == "text 10\nline two"


def test_explode_pages_names(spark):
    df = spark.createDataFrame([("7", "doc_7", "l1\nl2\nl3\nl4")], "input_id string, stem string, text string")
    got = sorted((r.page_no, r.page_name, r.n_lines, r.text) for r in explode_pages(df, 3).collect())
    assert got == [(0, "doc_7_page_1.pdf", 3, "l1\nl2\nl3"), (1, "doc_7_page_2.pdf", 1, "l4")]


def test_missing_inputs(spark):
    req = spark.createDataFrame([("a",), ("b",), ("b",)], "input_id string")
    have = spark.createDataFrame([("a",)], "input_id string")
    assert [r.input_id for r in missing_inputs(req, have).collect()] == ["b"]


def test_manifest_sorts_as_strings(spark):
    docs = spark.createDataFrame([("x", n, f"t{n}") for n in range(12)], "input_id string, document_no int, topic_name string")
    got = [r.name for r in sorted(output_names(docs).collect(), key=lambda r: r.position)]
    assert got[:4] == ["document_0_t0", "document_10_t10", "document_11_t11", "document_1_t1"]


def test_text_scan_keeps_files_without_a_page_number(spark, scratch):
    with open(os.path.join(scratch, "readme.txt"), "w") as fh:
        fh.write("x")
    assert [(r.input_stem, r.page_no, r.text) for r in scan_page_texts(spark, scratch).collect()] == [("readme", None, "x")]


def test_staged_texts_come_back(spark, scratch):
    pages = spark.createDataFrame([("doc_1_page_1.pdf", "a\n"), ("doc_1_page_2.pdf", ""), ("doc_2_page_1.pdf", "b\n\nc")], "page_name string, text string")
    stage_page_texts(pages, scratch + "/out")
    got = sorted((r.input_stem, r.page_no, r.text) for r in scan_page_texts(spark, scratch + "/out").collect())
    assert got == [("doc_1", 0, "a\n"), ("doc_1", 1, ""), ("doc_2", 0, "b\n\nc")]


def test_small_pages_are_staged_by_many_tasks(spark, scratch):
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "true")  # Spark's default, which looks at bytes only
    try:
        pages = spark.range(60).selectExpr("format_string('doc_%d_page_1.pdf', id) AS page_name", "'a' AS text")
        stage_page_texts(pages, scratch + "/out")
    finally:
        spark.conf.set(merging, before)
    files = [f for _, _, names in os.walk(scratch + "/out") for f in names if f.startswith("part-")]
    assert len(files) == 60 and len({f.split("-")[1] for f in files}) == spark.sparkContext.defaultParallelism


def test_listing_opens_no_file(spark, scratch):
    for name in ["a.pdf", "b.txt"]:
        with open(os.path.join(scratch, name), "wb") as fh:
            fh.write(b"xy")
    df = scan_page_files(spark, scratch, content=False)
    assert [(r.name, r.length) for r in df.collect()] == [("a.pdf", 2)] and df.columns == ["path", "name", "length"]


def test_explode_pages_without_shuffle(spark):
    df = spark.createDataFrame([("7", "doc_7", "l1\nl2")], "input_id string, stem string, text string")
    assert exchanges(explode_pages(df, 3)) == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


DOCS = "input_id string, document_no int, topic_name string"
BODIES = "input_id string, document_no int, page_no int, text string"


def _stored(spark, out):
    return sorted(((r.input_id, r.document_no, r.page_no, r.text) for r in read_documents(spark, out).collect()), key=str)


def test_a_second_run_replaces_an_inputs_documents(spark, scratch):
    out = os.path.join(scratch, "docs")
    bodies = spark.createDataFrame([("a", 0, 0, "p0"), ("a", 0, 1, "p1"), ("a", 1, 2, "p2"), ("b", 0, 0, "q")], BODIES)
    named = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], DOCS)
    write_documents(bodies, named, out)
    write_documents(bodies, named, out)  # a re-run rewrites, never duplicates
    assert len(_stored(spark, out)) == 4
    few = "input_id = 'a' AND document_no = 0"
    write_documents(bodies.where(few), named.where(few), out)
    assert _stored(spark, out) == [("a", 0, 0, "p0"), ("a", 0, 1, "p1"), ("b", 0, 0, "q")]


def test_reset_clears_the_named_inputs_only(spark, scratch):
    out, ids = os.path.join(scratch, "docs"), ["a:b", "c", "zz/../input_id=c", "..", "é %", None]
    write_documents(spark.createDataFrame([(i, 0, 0, "t") for i in ids[:-1]], BODIES), spark.createDataFrame([(i, 0, "x") for i in ids[:-1]], DOCS), out)
    for gone in ("a:b", "zz/../input_id=c", "..", None):
        reset_outputs(out, spark.createDataFrame([(gone,)], "input_id string"))
    assert [r[0] for r in _stored(spark, out)] == ["c", "é %"]
    write_documents(spark.createDataFrame([], BODIES), spark.createDataFrame([], DOCS), out, inputs=spark.createDataFrame([("c",)], "input_id string"))
    assert [r[0] for r in _stored(spark, out)] == ["é %"]


def test_vector_store_keeps_pages_and_computes_once(spark, scratch):
    store, asked = scratch + "/store", []
    rows = [("a", 0, "x y"), ("a", 1, None), ("b", 0, "x y"), ("b", 1, "")] + [("c", p, "x y") for p in range(20)]
    pages = spark.createDataFrame(rows, "input_id string, page_no int, text string")

    def vectoriser(texts):
        asked.append(texts.count())
        return text_vectors(texts)

    first = embed_missing(pages.where("input_id = 'a'"), store, vectoriser=vectoriser)
    assert first.count() == 2
    again = embed_missing(pages, store, vectoriser=vectoriser).collect()
    embed_missing(pages, store, vectoriser=vectoriser)
    assert asked == [2, 1, 0] and len(again) == len(rows)
    vectors = {(r.input_id, r.page_no): r.embedding for r in again}
    assert set(vectors["a", 1]) == set(vectors["b", 1]) == {0.0} and vectors["a", 0] == vectors["c", 7] != vectors["b", 1]


def test_vector_store_reads_wanted_partitions_and_completes_a_broken_append(spark, scratch):
    import glob

    store = scratch + "/store"
    pages = spark.createDataFrame([("a", p, f"word{p}") for p in range(300)], "input_id string, page_no int, text string")
    embed_missing(pages, store)
    folder = f"{store}/vectoriser=hashed"
    few = pages.where("page_no < 3").select(F.md5("text").alias("text_hash"))
    read = stored_vectors(spark, folder, few)
    assert 0 < read.count() < 20 and "PartitionFilters: [prefix" in read._jdf.queryExecution().toString()
    for f in glob.glob(f"{folder}/*/*.parquet")[::2]:  # as if the append had been broken off
        os.remove(f)
    assert embed_missing(pages, store).count() == 300
    rows = [r.text_hash for r in spark.read.parquet(folder).collect()]
    assert len(rows) == len(set(rows)) == 300


def _topics(n, seed=0):
    words = [["alpha", "beta", "gamma"], ["uno", "dos", "tres"], ["eins", "zwei", "drei"]]
    return [" ".join(words[(p * 3) // n]) * 3 for p in range(n)]


def test_default_boundary_threshold_splits(spark):
    pages = spark.createDataFrame([("a", p, t) for p, t in enumerate(_topics(12))], "input_id string, page_no int, text string")
    assert sorted((r.page_start, r.page_end) for r in split_pages(pages, method="boundary").collect()) == [(0, 3), (4, 7), (8, 11)]


def test_whole_run_writes_names_and_manifest(spark, scratch):
    out = scratch + "/run"
    rows = [("a", p, t) for p, t in enumerate(_topics(12))] + [(None, 0, "no input"), ("b", None, "no page")]
    pages = spark.createDataFrame(rows, "input_id string, page_no int, text string")
    namer = lambda texts: texts.select("input_id", "document_no", F.lit("T").alias("topic"))
    calls = []

    def vectoriser(texts):
        calls.append(1)
        return text_vectors(texts)

    run_split(pages, out, method="cluster", threshold=0.05, vectoriser=vectoriser)
    assert read_documents(spark, out).select("document_no").distinct().count() == 12 and calls == [1]
    names = [(r.name, r.position) for r in run_split(pages, out, method="boundary", namer=namer).orderBy("position").collect()]
    assert names == [("document_0_T", 0), ("document_1_T", 1), ("document_2_T", 2)]
    got = read_documents(spark, out).groupBy("name").count().collect()
    assert sorted((r["name"], r["count"]) for r in got) == [("document_0_T", 4), ("document_1_T", 4), ("document_2_T", 4)]
    kept, rejected = named_pages(pages)
    assert (kept.count(), rejected.count()) == (12, 2)


@pytest.mark.parametrize("level", [0.0, 5.1, -1])
def test_split_level_out_of_range(level):
    assert split_level(0.1) == 0.1 and split_level(5) == 5.0
    with pytest.raises(ValueError):
        split_level(level)


def test_intake_joins_pages_that_come_in_several_files(spark, scratch):
    schema = "input_id string, page_no int, text string"
    rows = [("a", p, t) for p, t in enumerate(_topics(40))]
    src = scratch + "/in"
    for part in (rows[:20], rows[20:] + [(None, 3, "lost")], [("b", 0, "alone")], rows[:20]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    struct = spark.createDataFrame([], schema).schema
    start_intake(spark, src, struct, scratch + "/out", scratch + "/ck", max_files_per_trigger=1, method="boundary").awaitTermination()
    docs = spark.read.parquet(scratch + "/out/documents")
    assert sorted((r.input_id, r.page_start, r.page_end) for r in docs.collect()) == [("a", 0, 13), ("a", 14, 26), ("a", 27, 39), ("b", 0, 0)]
    assert all(r.topic_name and not r.topic_name.startswith("Cluster") for r in docs.collect())
    assert len(_stored(spark, scratch + "/out/outputs")) == 41
    assert spark.read.parquet(scratch + "/out/rejected").count() == 1


def test_a_batch_reads_the_buckets_of_its_inputs_only(spark, scratch):
    schema = "input_id string, page_no int, text string"
    src, read = scratch + "/in", []
    for k in range(5):
        spark.createDataFrame([(f"in{k}", p, f"word{p}") for p in range(3)], schema).coalesce(1).write.mode("append").parquet(src)
    real = intake.stored_pages

    def watched(*args):
        found = real(*args)
        read.append(len(found.inputFiles()))
        return found

    intake.stored_pages = watched
    try:
        start_intake(spark, src, spark.createDataFrame([], schema).schema, scratch + "/out", scratch + "/ck", max_files_per_trigger=1, method="boundary").awaitTermination()
    finally:
        intake.stored_pages = real
    assert len(read) == 5 and max(read) <= 2 * min(read)  # a bucket's files, not those of the batches before
    assert spark.read.parquet(scratch + "/out/documents").select("input_id").distinct().count() == 5


def test_a_namer_that_fails_on_one_document_names_the_others(spark):
    rows = [("a", 0, "fine"), ("a", 1, "bad"), ("a", 2, None), ("b", 0, "blank"), ("b", 1, "fine too"), *[("c", n, f"t{n}") for n in range(70)]]
    text = spark.createDataFrame([(i, n, 0, t) for i, n, t in rows], "input_id string, document_no int, page_no int, text string")
    docs = spark.createDataFrame([(i, n, f"Cluster {n}") for i, n, _ in rows], "input_id string, document_no int, topic_name string")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no topic for this")
        return ["" if t == "blank" else t.upper() for t in texts]

    got = {(r.input_id, r.document_no): (r.topic_name, r.topic_error) for r in assign_topics(docs, text, namer=model_namer(model)).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if k[0] != "c"} == {
        ("a", 0): ("FINE", None), ("a", 1): ("Cluster 1", "RuntimeError: no topic for this"), ("a", 2): ("Cluster 2", None), ("b", 0): ("Cluster 0", None), ("b", 1): ("FINE TOO", None),
    }
    assert all(got["c", n] == (f"T{n}", None) for n in range(70))
    short = assign_topics(docs, text, namer=model_namer(lambda texts: texts[:-1])).collect()
    assert all(r.topic_name == f"Cluster {r.document_no}" for r in short) and sum(r.topic_error is not None for r in short) == len(rows) - 1


def test_online_input_with_a_lost_page_closes(spark, scratch):
    schema = "input_id string, page_no int, embedding array<double>, at timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    src = scratch + "/src"
    for rows in ([("a", 0, [1.0, 0.0], at(0)), ("a", 1, [1.0, 0.1], at(1)), ("a", 3, [0.0, 1.0], at(2))], [("b", 0, [1.0, 0.0], at(5000))], [("b", 1, [1.0, 0.0], at(5001))], [("a", 4, [1.0, 0.0], at(5002))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = online_boundaries(stream, 0.4, event_time="at", close_after_seconds=60).writeStream.format("memory").queryName("online_close").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.input_id, r.page_no): r.status for r in spark.table("online_close").collect()}
    assert len(got) == 6 and got["a", 4] == "late", got
    assert got["a", 0] == got["a", 1] == got["b", 0] == got["b", 1] == "ok" and got["a", 3] == "rejected"


def test_online_boundaries_equal_batch_fold(spark, scratch):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(3):
        topic = rng.normal(size=6)
        for p in range(30):
            if rng.random() < 0.2:
                topic = rng.normal(size=6)
            rows.append((f"in{k}", p, [float(z) for z in topic + 0.4 * rng.normal(size=6)]))
    random.Random(0).shuffle(rows)
    schema = "input_id string, page_no int, embedding array<double>"
    src = os.path.join(scratch, "src")
    for b in range(5):  # five out-of-order arrivals
        spark.createDataFrame(rows[b::5], schema).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (
        online_boundaries(stream, 0.4).writeStream.format("memory").queryName("online_test")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {(r.input_id, r.page_no): r.label for r in spark.table("online_test").where(F.col("status") == "ok").collect()}
    exp = {(r.input_id, r.page_no): r.label for r in boundary_fold(spark.createDataFrame(rows, schema), 0.4).collect()}
    assert got == exp and len(got) == 90


def test_names_and_first_pages_move_no_texts(spark, scratch):
    """Texts are shuffled once to meet their pages, and not again to meet the names or to find the first page; repeated rows keep their number."""
    from quire.operators import documents as D
    from quire.sinks import outputs as O

    pages = spark.createDataFrame([("a", p, f"text {p}") for p in range(40)], "input_id string, page_no int, text string")
    doc_pages = spark.createDataFrame([("a", p // 4, p) for p in range(40)], "input_id string, document_no int, page_no int")
    doc_text = D.page_texts(doc_pages, pages)
    first = D.first_page_text(doc_text)
    assert sorted(tuple(r) for r in first.collect()) == [("a", d, f"text {4 * d}") for d in range(10)]
    names = doc_pages.select("input_id", "document_no").distinct().withColumn("topic_name", F.lit("t"))
    out = f"{scratch}/named"
    O.write_documents(doc_text.unionByName(doc_text.where("page_no = 5")), names, out)
    got = [(r.document_no, r.page_no, r.text, r.name) for r in O.read_documents(spark, out).collect()]
    assert sorted(got) == sorted([(p // 4, p, f"text {p}", f"document_{p // 4}_t") for p in [*range(40), 5]])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with_names = D.with_pages(doc_text, doc_pages.join(names, ["input_id", "document_no"]))
        plan = with_names._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(texts) == 5 and plan.count("SortMergeJoin") == 3, plan  # pages, texts, pages again, names, and the named pages


def test_first_texts_are_not_shuffled_to_their_documents(spark):
    doc_pages = spark.createDataFrame([("x", 0, 0), ("x", 0, 2), ("x", 1, 1)], "input_id string, document_no int, page_no int")
    pages = spark.createDataFrame([("x", n, f"t{n}") for n in range(3)], "input_id string, page_no int, text string")
    first = page_texts(first_pages(doc_pages), pages)
    assert first._jdf.queryExecution().executedPlan().toString().count("Exchange") == first._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    assert sorted((r.document_no, r.page_no, r.text) for r in first.collect()) == [(0, 0, "t0"), (1, 1, "t1")]


def test_words_are_counted_once_for_topics(spark):
    texts = spark.createDataFrame([("x", 0, "aa aa bb"), ("x", 1, "cc bb")], "input_id string, document_no int, text string")
    topics = tfidf_topics(texts)
    assert "Generate" not in topics._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.document_no, r.topic) for r in topics.collect()) == [(0, "aa_bb"), (1, "cc_bb")]

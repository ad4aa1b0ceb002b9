"""Distributed page numbering equals row_number() even when one input is hot and spans many
partitions, and keeps rows whose order value is null."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.numbering import dense_rank_within, number_rows


def number_rows_window(df, key, order, out="page_no"):
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("int"))


def test_hot_input_numbered_like_row_number(spark):
    # input "hot" holds two thirds of the rows; order column is not the physical order
    rows = [("hot", (i * 7919) % 20000, i) for i in range(20000)] + [(f"k{i % 50}", i, i) for i in range(10000)]
    df = spark.createDataFrame(rows, "input_id string, seq int, rid int").repartition(24)
    got = number_rows(df, "input_id", ["seq", "rid"])
    exp = number_rows_window(df, "input_id", ["seq", "rid"])
    diff = got.select("input_id", "rid", "page_no").exceptAll(exp.select("input_id", "rid", "page_no"))
    assert got.count() == 30000 and diff.count() == 0
    hot = got.where(F.col("input_id") == "hot").agg(F.min("page_no"), F.max("page_no"), F.countDistinct("page_no")).first()
    assert tuple(hot) == (0, 19999, 20000)


def test_null_order_values_keep_their_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "y", 3)], "input_id string, lang string, rid int")
    got = sorted((r.rid, r.page_no) for r in number_rows(df, "input_id", ["lang", "rid"]).collect())
    assert got == [(1, 0), (2, 1), (3, 2)]


def test_null_keys_and_values_keep_their_rank(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "y", 3), (None, None, 4)], "input_id string, lang string, rid int")
    got = {r.rid: r.gold for r in dense_rank_within(df, "input_id", "lang", "gold").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_rows_with_a_null_key_are_numbered_as_a_group(spark):
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "input_id string, rid int").repartition(12)
    got = number_rows(df, "input_id", ["rid"]).select("input_id", "rid", "page_no")
    exp = number_rows_window(df, "input_id", ["rid"]).select("input_id", "rid", "page_no")
    assert got.count() == 3000 and got.exceptAll(exp).count() == 0
    assert sorted(r.page_no for r in got.where("input_id IS NULL").collect()) == list(range(1000))


def test_f2_and_f4_keep_pages_without_source_or_address(spark, scratch):
    docs = [(i, None if i < 4 else "s", "en", f"text {i}") for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{scratch}/documents.parquet")
    pages = [(i, None if i < 4 else f"http://a.org/{i}", "<p>x</p>") for i in range(10)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    from quire.functions import text as T
    from quire.operators.vectorize import text_vectors
    from quire.sources import tables

    f2, f4 = tables.text_pages(spark, scratch), tables.raw_pages(spark, scratch)
    for view, name in ((f2, "doc_id"), (f4, "page_id")):
        got = {r[name]: (r.input_id, r.page_no) for r in view.collect()}
        assert len(got) == 10 and [got[i] for i in range(4)] == [(tables.NO_INPUT, i) for i in range(4)]
    assert text_vectors(f2).count() == 10 and f4.select(T.html_to_text("html")).count() == 10


def test_repeated_rows_are_numbered_one_by_one(spark):
    rows = [("a", 1, "x")] * 3 + [("a", 2, "y")] * 2 + [("b", None, "z")] * 4 + [(None, None, None)] * 3000 + [("b", 7, "w")]
    df = spark.createDataFrame(rows, "input_id string, seq int, text string").repartition(9)
    got = number_rows(df, "input_id", ["seq"]).collect()
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        own = sorted((r.page_no, r.seq if r.seq is not None else -1) for r in got if r.input_id == key)
        assert [p for p, _ in own] == list(range(len(own))) and [q for _, q in own] == sorted(q for _, q in own)
    assert sorted((r.input_id or "", r.seq or 0, r.text or "") for r in got) == sorted((a or "", b or 0, c or "") for a, b, c in rows)


def test_views_with_repeated_and_null_ids_against_row_number(spark, scratch):
    docs = [(None if i % 3 == 0 else i % 7, "s", "en" if i % 2 else "de", f"text {i}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{scratch}/documents.parquet")
    pages = [(None if i % 3 == 0 else i % 7, "http://a.org/x", f"<p>{i}</p>") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    vecs = [(i % 40, [float(i)], i % 2) for i in range(60)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int").write.parquet(f"{scratch}/embeddings.parquet")
    from quire.sources import tables

    for view, order in ((tables.vector_pages, ["gold", "vec_id"]), (tables.text_pages, ["lang", "doc_id"]), (tables.raw_pages, ["page_id"])):
        got = view(spark, scratch)
        ranks = lambda df: sorted(tuple((r[c] is not None, r[c]) for c in ["page_no", *order]) for r in df.collect())  # noqa: B023, E731
        assert ranks(got) == ranks(number_rows_window(got.drop("page_no"), "input_id", order)) and got.count() == 60


def test_numbers_and_ranks_meet_their_rows_without_a_shuffle_of_them(spark):
    rows = [(f"k{i % 7}", f"l{i % 3}", i, "x" * 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "input_id string, lang string, rid int, text string").repartition(6)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    numbered = plan(number_rows(df, "input_id", ["rid"]))
    assert "BroadcastHashJoin" in numbered and "SortMergeJoin" not in numbered and "hashpartitioning" not in numbered
    ranked = plan(dense_rank_within(df, "input_id", "lang", "gold"))
    assert "BroadcastHashJoin" in ranked and "SortMergeJoin" not in ranked

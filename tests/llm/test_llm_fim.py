"""Cuts by the learned rank index against Python strings."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import fim, queries

SF001 = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_op12_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op12_learned_rank_fim(spark, SF001).collect()
    assert len(got) == len(docs) and len({r["form"] for r in got}) == 3
    for r in got:
        n, form, prefix, middle, output = plain(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(output), sha(docs[r["doc_id"]] or ""))


@pytest.mark.parametrize("seed", range(6))
def test_index_is_exact_and_its_error_bounded(seed):
    rng = np.random.default_rng(seed)
    kinds = ["a", "ß", "漢", "😀", "\0"]
    text = "".join(kinds[rng.integers(len(kinds))] * int(rng.integers(1, 400)) for _ in range(int(rng.integers(0, 60))))
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.RankIndex.of(data, error=20, block=1000)
    want = np.cumsum([0] + [len(c.encode()) for c in text])
    assert len(index) == len(text) and (index.lookup(np.arange(len(text) + 1)) == want).all()
    assert len(index.residuals) == len(text) + 1 and np.abs(index.residuals.astype(int)).max() <= 21
    assert (index.residuals.dtype, index.ranks[0]) == (np.int8, 0)


def test_a_long_text_of_one_width_is_one_piece_per_block():
    data = np.frombuffer("漢".encode() * 200_000, np.uint8)
    index = fim.RankIndex.of(data)
    assert len(index.ranks) <= len(data) // fim.BLOCK + 2 and not index.residuals.any()
    assert index.lookup([0, 7, 199_999, 200_000]).tolist() == [0, 21, 599_997, 600_000]


def test_stored_index_answers_other_cuts(spark):
    text = "naïve ☃ text " * 5000
    row = fim.transform(spark.createDataFrame([(3, text)], "doc_id long, text string"), keep_index=True).first()
    index = fim.RankIndex(*(np.array([s[c] for s in row["segments"]]) for c in ("rank", "offset", "slope")), np.frombuffer(row["residuals"], np.int8))
    for rank in (0, 1, 777, 40_000, len(text)):
        assert text.encode()[: int(index.lookup(rank))] == text[:rank].encode()


def test_odd_rows(spark):
    texts = [None, "", "x", "ü", "a <P> b", "<", "<<S", "P><M", "é" * 300_000, "word " * 100_000, "\0\0", "<S", "M>" * 9]
    rows = [(i, t) for i in range(7) for t in texts] + [(None, "abc"), (None, "abc")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    got = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((i, *plain(i, t)) for i, t in rows), key=key)
    assert sorted(sha(r["back"]) for r in got) == sorted(sha(t or "") for _, t in rows)
    assert fim.transform(docs.limit(0)).collect() == []
    text_ids = spark.createDataFrame([("k", "abcdef")], "doc_id string, text string")
    assert fim.transform(text_ids).first()["output"] == plain("k", "abcdef")[4]

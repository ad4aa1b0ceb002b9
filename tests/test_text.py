"""Text functions against plain-Python references: hashed term vectors (P5), markup to text
(P4), short segments (P3), names (P2)."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions.text import file_stem, html_to_text, long_segments, text_file_name, vectors_file_name
from quire.operators.vectorize import sparse_vectors, text_vectors

TEXTS = [
    "The cat, the CAT and the dog.",
    "Straße und Übermaß – ñandú, café!",
    "",
    "1234 ... !!!",
    "a b c a",
]


def ref_vector(text, cells=64):
    words = [w for w in re.split(r"[^\w]+|[\d_]+", text.lower()) if w]
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % cells for w in words)
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {c: n / norm for c, n in counts.items()} if norm else {}


def test_hashed_vectors_match_python(spark):
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(TEXTS)], "input_id string, page_no int, text string")
    got = {}
    for r in sparse_vectors(df, ["input_id", "page_no"]).collect():
        got.setdefault(r.page_no, {})[r.cell] = r.value
    for i, t in enumerate(TEXTS):
        exp = ref_vector(t)
        assert set(got.get(i, {})) == set(exp)
        for c, v in exp.items():
            assert got[i][c] == pytest.approx(v, abs=1e-12)
    dense = {r.page_no: r.embedding for r in text_vectors(df).collect()}
    assert dense[2] == [0.0] * 64 and dense[3] == [0.0] * 64  # no letters: the zero vector
    assert sum(x * x for x in dense[0]) == pytest.approx(1.0)


def test_html_to_text(spark):
    html = "<html><head><style>p{x}</style><SCRIPT a=1>var t='</p>';</SCRIPT></head><!-- c\nd --><body><p>Hello\n  <b>world</b></p></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(html_to_text("h").alias("t")).first().t
    assert got == "Hello world"


def test_short_segments_and_names(spark):
    df = spark.createDataFrame([("a\nbb\n\nccc\nd", "/x/doc_7_page_3.pdf")], "t string, p string")
    r = df.select(
        long_segments("t").alias("segs"), file_stem("p").alias("stem"), text_file_name("p").alias("txt"), vectors_file_name("p").alias("vec")
    ).first()
    assert r.segs == ["bb", "ccc"]
    assert (r.stem, r.txt, r.vec) == ("doc_7_page_3", "doc_7_page_3.txt", "doc_7_page_3_embeddings")


def test_vectors_are_made_without_a_shuffle(spark):
    rows = [("a", 0, "Straße straße İstanbul ΟΔΟΣ x1y"), ("a", 1, None), ("a", 2, ""), ("a", 3, " .. "), ("b", 0, "word " * 200_000), ("b", 0, "word " * 3)]
    df = spark.createDataFrame(rows, "input_id string, page_no int, text string")
    got = text_vectors(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    vectors = [r.embedding for r in got.collect()]
    assert len(vectors) == 6 and all(len(v) == 64 for v in vectors) and all(not any(v) for v in vectors[1:4]) and vectors[4] == vectors[5]
    words = [r[0] for r in df.limit(1).selectExpr("explode(split(lower(text), '[^\\\\p{L}]+')) AS w").where("w != ''").collect()]
    counts = [0] * 64
    for w in words:
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    norm = sum(c * c for c in counts) ** 0.5
    assert max(abs(c / norm - v) for c, v in zip(counts, vectors[0])) < 1e-12


def test_words_of_a_batch_are_counted_in_strips(spark, monkeypatch):
    """What the vector function holds per word doesn't grow with the batch; strips give what one row alone gives."""
    import pyarrow as pa

    from quire.operators import vectorize as vz

    count = vz._counter(8).func
    rows = [["a", "b", "", "a"], None, [], ["c"] * 3, ["b", "d"]] * 7
    whole = count(pa.array(rows, pa.list_(pa.string())))
    alone = [count(pa.array([r], pa.list_(pa.string()))).to_pylist()[0] for r in rows]
    monkeypatch.setattr(vz, "STRIP_ROWS", 4)
    assert count(pa.array(rows, pa.list_(pa.string()))).to_pylist() == whole.to_pylist() == alone
    import tracemalloc

    monkeypatch.setattr(vz, "STRIP_ROWS", 64)
    long = pa.array([["w"] * 200] * 4096, pa.list_(pa.string()))
    tracemalloc.start()
    count(long)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4096 * 200 * 8  # bytes of one number per word

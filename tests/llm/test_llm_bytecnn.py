"""The network's pooling against a plain version; held-out accuracy on given labels."""

import numpy as np
from pyspark.sql import functions as F
from quire.llm import bytecnn, queries
from quire.llm.common import held_out

SF01 = "/root/testdata/sf0.01"


def plain_score(text, net):
    half = bytecnn.CHUNK // 2
    n = max(1, -(-(len(text) + bytecnn.WIDTH - 1) // half))
    x = [bytecnn.EMPTY] * (bytecnn.WIDTH - 1) + list(text) + [bytecnn.EMPTY] * (n * half - len(text))
    r = np.array([sum(net.filters[j, x[t + j]].astype(float) for j in range(bytecnn.WIDTH)) for t in range(n * half)])
    chunks = [r[a * half : (a + 2) * half].max(0) for a in range(max(1, n - 1))]
    active = np.maximum(np.array(chunks) + net.bias, 0)
    z = np.concatenate((active.mean(0), active.max(0))) @ net.unit + net.offset
    return 1 / (1 + np.exp(-z))


def test_scores_equal_plain_sums():
    rng = np.random.default_rng(0)
    net = bytecnn.Network(rng.normal(0, 1, (bytecnn.WIDTH, 257, bytecnn.FILTERS)).astype(np.float32), rng.normal(0, 1, bytecnn.FILTERS).astype(np.float32), rng.normal(0, 0.3, 2 * bytecnn.FILTERS), 0.2)
    net.filters[:, bytecnn.EMPTY] = 0
    texts = [b"", b"a", bytes(range(256)), rng.integers(0, 256, 508, dtype=np.uint8).tobytes(), rng.integers(0, 256, 509, dtype=np.uint8).tobytes(), rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()]
    assert np.allclose(bytecnn.scores(texts, net), [plain_score(t, net) for t in texts], atol=1e-5)
    long = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    together = bytecnn.scores([long, *texts], net)
    assert np.allclose(together[1:], bytecnn.scores(texts, net), atol=1e-6) and np.allclose(together[0], bytecnn.scores([long], net)[0], atol=1e-6)


def test_gradient_steps_learn_a_byte_pattern():
    rng = np.random.default_rng(1)
    base = [bytes(rng.choice(list(b"abcdefgh "), 700).astype(np.uint8)) for _ in range(200)]
    texts = [t if i % 2 else t[:300] + b"!!x!!" + t[300:] for i, t in enumerate(base)]
    labels = np.array([i % 2 for i in range(200)], float)
    net = bytecnn.train(texts, labels)
    assert ((bytecnn.scores(texts, net) >= 0.5) == labels).mean() > 0.97


def test_held_out_accuracy(spark):
    got = queries.op5_byte_cnn(spark, SF01)
    assert got.count() == 1000
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(bad) > 5 and sum(r["predicted"] for r in good) / len(good) > 0.97
    assert sum(r["predicted"] for r in bad) / len(bad) < 0.2  # 2 of the 11 here
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 150_000, "c"), (3, "x" * 150_000, "c"), (None, "no id", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (3, 1)], "doc_id long, quality int")
    net = bytecnn.fit(docs, labels)
    got = {(r["doc_id"]): r["score"] for r in bytecnn.score_documents(docs, net).collect()}
    assert got[1] == got[2] and len(got) == 4
    kept = bytecnn.keep_good(docs, net, 0.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert bytecnn.keep_good(docs, net, 1.1).collect() == []
    empty = bytecnn.fit(docs, labels.limit(0))
    assert {r["score"] for r in bytecnn.score_documents(docs, empty).collect()} == {0.5}
    assert bytecnn.score_documents(docs.limit(0), net).collect() == []


def test_held_out_rows_are_never_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    flags = {r[0] for r in docs.where(held_out(F.col("doc_id"))).collect()}
    assert 20 < len(flags) < 60
    one, two = (bytecnn.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0) if i not in flags else k) for i in range(200)], "doc_id long, quality int")) for k in (0, 1))
    assert (one.filters == two.filters).all() and one.offset == two.offset

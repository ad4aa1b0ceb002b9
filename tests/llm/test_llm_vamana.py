"""Graph search against all pairs."""

import numpy as np
import pytest
from quire.llm import queries, vamana

SF01 = "/root/testdata/sf0.01"


def brute(rows, k=5, every=50):
    """rows: (vec_id, vector) that take part -> {query: [(vec_id, score)]}"""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = u @ u[q]
        order = sorted((-round(s, 12), i) for s, i in zip(score, ids) if i != ids[q])
        out[ids[q]] = [(i, -s) for s, i in order[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) <= set(want)
    hits = sum(len({v for _, v, _ in found.get(q, [])} & {v for v, _ in near}) for q, near in want.items())
    for q, own in found.items():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, len(own) + 1)) and all(v != q for _, v, _ in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
    return hits / sum(map(len, want.values()))


def test_op8_recall_on_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    assert recall(queries.op8_pruned_graph(spark, SF01).collect(), brute(rows)) >= 0.95


def test_recall_over_shards_of_random_vectors(spark):
    x = np.random.default_rng(0).normal(size=(4000, 32))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    usable = vamana.valid(docs)
    got = vamana.search(vamana.index(usable, shard_rows=900), usable.where("vec_id % 50 = 0")).collect()
    want = brute(list(enumerate(x)))
    assert recall(got, want) >= 0.95
    for r in got[:50]:
        a, b = x[r["query_id"]], x[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_a_search_scores_few_nodes_of_a_large_shard():
    """Recall and the share of scored nodes at two sizes: the share falls as the shard grows."""
    rng, shares = np.random.default_rng(3), []
    for n in (1500, 6000):
        x = vamana.unit(np.repeat(rng.normal(size=(n // 20, 24)), 20, axis=0) + 0.4 * rng.normal(size=(n // 20 * 20, 24))).astype(np.float32)
        graph, entry = vamana.build(x)
        scored, q = [], x[:: n // 100]
        found, _ = vamana.beam_search(x, graph, entry, q, vamana.SEARCH_BEAM, scored=scored)
        want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :6]
        assert np.mean([len(set(a) & set(b[:6])) / 6 for a, b in zip(want, found)]) >= 0.95
        shares.append(np.mean(scored) / len(x))
    assert shares[1] < 0.5 * shares[0] and shares[1] < 0.25


def test_pruned_edges_are_diverse():
    rng = np.random.default_rng(1)
    x = vamana.unit(rng.normal(size=(300, 8))).astype(np.float32)
    graph, entry = vamana.build(x, degree=8, beam=24)
    assert graph.shape == (300, 8) and 0 <= entry < 300
    for i, own in enumerate(graph):
        own = own[own >= 0]
        assert len(set(own)) == len(own) and i not in own
    kept = vamana.robust_prune(x, np.array([0]), np.arange(1, 300)[None, :], 1.0, 8)[0]
    kept = kept[kept >= 0]
    d = lambda a, b: 2 - 2 * float(x[a] @ x[b])
    for k, c in enumerate(kept):
        assert all(d(p, c) > d(0, c) - 1e-6 for p in kept[:k])


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 2.0]), (9, None), (100, [0.0, 0.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [None, 1.0]), (13, []), (150, [1.0, 2.0, 3.0]), (14, [1e300, -1e300]), (None, [1.0, 1.0])]
    return spark.createDataFrame([(*r, 3, "k") for r in rows], "vec_id long, embedding array<double>, label int, key string")


def test_odd_rows(odd):
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in vamana.nearest(odd).collect()}
    half = round(0.5**0.5, 9)
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 1): (7, 1.0), (0, 2): (50, 1.0), (0, 3): (8, half), (0, 4): (14, half)}
    assert got[50, 1] == (0, 1.0) and got[50, 2] == (7, 1.0) and {q for q, _ in got} == {0, 50}
    assert vamana.nearest(odd.limit(0)).collect() == []


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(600)] + [(600 + i, [float(i), 1.0]) for i in range(40)]
    got = {}
    for r in vamana.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got[0]) == [1, 2, 3, 4, 5] and sorted(got[300]) == [0, 1, 2, 3, 4] and len(got) == 13

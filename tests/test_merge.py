"""Greedy merging (numpy, per task) against a brute-force loop over cluster pairs."""

import numpy as np
import pytest

from quire.operators.merge import blended_matrix, greedy_merges, labels_at, settle


def brute_labels(d, linkage, t):
    """Textbook agglomeration: recompute every cluster-pair linkage from page distances each
    step; merge the least (rounded distance, low id, high id) below t."""
    n = d.shape[0]
    clusters = {i: [i] for i in range(n)}
    agg = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
    while len(clusters) > 1:
        best = None
        ids = sorted(clusters)
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                a, b = ids[x], ids[y]
                v = round(float(agg(d[np.ix_(clusters[a], clusters[b])])), 9)
                key = (v, a, b)
                if best is None or key < best:
                    best = key
        if best[0] >= t:
            break
        _, a, b = best
        clusters[a] = clusters[a] + clusters.pop(b)
    out = np.zeros(n, dtype=int)
    for cid, members in clusters.items():
        out[members] = cid
    return out


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_equals_brute_force(linkage, seed):
    rng = np.random.default_rng(seed)
    n = 24
    x = rng.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pages = np.arange(n)
    for alpha, t in [(0.85, 2.0), (0.9, 1.5), (1.0, 1.3), (1.2, 2.2)]:
        d = blended_matrix(x, pages, alpha)
        merges = greedy_merges(d, linkage)
        assert np.array_equal(labels_at(n, merges, t), brute_labels(d, linkage, t))


def test_ties_all_equal_pages():
    x = np.ones((6, 4))
    d = blended_matrix(x, np.arange(6), 1.0)  # every distance 0: ties everywhere
    merges = greedy_merges(d, "average")
    assert [m[:2] for m in merges] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)]
    assert labels_at(6, merges, 0.5).tolist() == [0] * 6


def test_threshold_is_strict():
    x = np.zeros((2, 2))
    d = blended_matrix(x, np.arange(2), 0.5)  # distance 0.5 exactly
    merges = greedy_merges(d, "single")
    assert labels_at(2, merges, 0.5).tolist() == [0, 1]
    assert labels_at(2, merges, 0.5000001).tolist() == [0, 0]


def test_small_inputs():
    assert greedy_merges(np.zeros((0, 0)), "average") == []
    assert greedy_merges(np.zeros((1, 1)), "average") == []
    assert labels_at(1, [], 2.0).tolist() == [0]


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_lower_threshold_never_fewer_clusters(linkage):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 6))
    d = blended_matrix(x, np.arange(30), 0.85)
    merges = greedy_merges(d, linkage)
    counts = [len(set(labels_at(30, merges, t).tolist())) for t in np.linspace(0.5, 6, 12)]
    assert counts == sorted(counts, reverse=True)


def test_what_can_still_merge_is_not_settled():
    d = np.full((4, 4), 9.0)
    for a, b, v in ((0, 1, 0.5), (1, 2, 1.2), (2, 3, 0.8)):
        d[a, b] = d[b, a] = v
    merges, settled = settle(d, np.ones(4), np.array([True, True, True, False]), "complete", 9, 2.0)
    assert merges == [(0, 1, 0.5)] and settled.tolist()[0] and not settled[2:].any()  # 2 is nearest to 3, which may merge elsewhere

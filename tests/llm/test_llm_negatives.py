"""Hard negatives against all pairs, and the bounds against exact scores."""

import math

import numpy as np
import pytest
from quire.llm import negatives, queries

SF01 = "/root/testdata/sf0.01"


def usable(rows):
    """vec_id -> (label, whole-number vector), the least of rows with one id."""
    out = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v) or sum(256 * c * 256 * c for c in v) >= 2.0**62:
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in v])
        out[i] = min(out.get(i, own), own)
    return out


def plain(rows, every=50):
    table, out = usable(rows), set()
    for a in (i for i in table if i % every == 0):
        label, x = table[a]
        scores = [(-sum(p * q for p, q in zip(x, v)), i, other == label) for i, (other, v) in table.items() if i != a and len(v) == len(x)]
        for p, pid in sorted((s, i) for s, i, alike in scores if alike)[:5]:
            band = sorted((s, i) for s, i, alike in scores if not alike and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out |= {(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(band, 1)}
    return out


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op11_whole_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    want = plain(rows)
    assert want and as_set(queries.op11_segment_negatives(spark, SF01)) == want


@pytest.mark.parametrize("dim", [1, 3, 16, 50])
def test_many_shards_hot_label_and_ties(spark, monkeypatch, dim):
    monkeypatch.setattr(negatives, "SHARD_LEAST", 40)
    monkeypatch.setattr(negatives, "SHARD_VALUES", 40 * dim)
    rng = np.random.default_rng(dim)
    base = np.round(rng.normal(size=(60, dim)) * 4) / 4
    rows = [(int(i), int(0 if i % 3 else rng.integers(10)), base[rng.integers(60)].tolist()) for i in range(600)]
    got = negatives.hard_negatives(negatives.relabelled(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")))
    assert as_set(got) == plain(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x = np.floor(256 * (rng.normal(size=(300, 48)) * 0.05 + np.repeat(rng.normal(size=(300, 4)), 12, axis=1)))
    side = negatives.Side(np.arange(300), np.zeros(300), x, *(s.astype(np.float32) for s in negatives.summaries(x)))
    exact, widths = x @ x.T, []
    for m, d in side.levels:
        middle, radius = m @ m.T, d @ d.T
        assert (np.abs(exact - middle) <= radius + 1e-6 * side.norm**2).all()
        widths.append(radius.mean())
    assert len(widths) == 3 and widths[0] > widths[1] > widths[2]
    seen = []
    alive = ~np.eye(300, dtype=bool)
    rows, cols = negatives.survivors(side, side, alive, lambda r, low, high: seen.append(high.size) or high >= np.sort(exact, 1)[r, -6][:, None])
    assert alive.sum() < 300 * 30 and seen[0] == 300 * 300
    assert all(alive[i, j] for i in range(300) for j in np.argsort(-exact[i])[:6] if i != j)


def test_percent_rounds_as_fractions_do():
    p = np.array([-(2**62), -101, -1, 0, 1, 99, 100, 12345, 2**62 - 1])
    for share in (50, 95):
        assert negatives.percent(p, share, False).tolist() == [int(v) * share // 100 for v in p]
        assert negatives.percent(p, share, True).tolist() == [-(-int(v) * share // 100) for v in p]


def test_odd_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 2.0**22
    rows = [(0, 1, [1.0, 0.5]), (50, 2, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9, 0.1]), (3, 2, [0.5, 0.5]), (4, 3, [0.5, 0.5]), (5, None, [1.0, 1.0]), (6, 1, None), (8, 1, [nan, 1.0]),
            (9, 1, [inf, 1.0]), (10, 1, [None, 1.0]), (None, 1, [1.0, 1.0]), (11, 1, []), (100, 1, []), (12, 4, []), (13, 1, [1.0]), (150, 1, [2.0]), (14, 9, [1.0]), (15, 1, [1e300, 1.0]), (200, 5, [big, 1.0, 7.0]),
            (16, 5, [big, 1.0, 7.0]), (17, 6, [big * 0.7, 1.0, 7.0]), (18, 6, [big * 0.9, -3.0, 7.0]), (250, 7, [0.0, 0.0]), (19, 7, [-1.0, -1.0])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, label int, embedding array<double>, vector string, shard int")
    assert as_set(negatives.hard_negatives(negatives.relabelled(df))) == plain(rows)
    assert negatives.hard_negatives(negatives.relabelled(df.limit(0))).collect() == []

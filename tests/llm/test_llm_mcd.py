"""Text statistics against plain Python; outlier estimates against a numpy version of the same steps."""

import re
from collections import Counter

import numpy as np
import pytest
from quire.llm import mcd, queries

SF001 = "/root/testdata/sf0.001"


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_estimate(x):
    """The steps of ``mcd.estimates`` for one group."""
    floors = np.array(mcd.FLOORS)
    classes = lambda d: np.floor(np.log2(d + 1) * mcd.CLASSES)

    def moments(rows):
        return rows.mean(0), (rows[:, :, None] * rows[:, None, :]).mean(0) - np.outer(rows.mean(0), rows.mean(0)) + np.diag(floors)

    def distance(mean, cov):
        y = x - mean
        return np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov), y)

    def covering(d, share):
        c = np.sort(classes(d))
        return c[int(np.ceil(share * len(c) - 1e-9)) - 1]

    rounded = np.sort(np.round(x * 32) / 32, 0)
    at = lambda q: rounded[int(np.ceil(q * len(x) - 1e-9)) - 1]
    mean, cov = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 + floors)
    for _ in range(mcd.STEPS):
        d = distance(mean, cov)
        mean, cov = moments(x[classes(d) <= covering(d, mcd.COVER)])
    factor = max(1.0, (2 ** (covering(distance(mean, cov), 0.5) / mcd.CLASSES) - 1) / mcd.CHI_MEDIAN)
    d = distance(mean, cov * factor)
    return distance(*moments(x[d <= mcd.CHI_975]))


def brute_judge(rows):
    """rows: (doc_id, text, lang, source) -> (doc_id, *statistics, base_failed, kept), distances."""
    stats = np.array([brute_statistics(r[1]) for r in rows], float).reshape(-1, 5)
    failed = (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])
    n = np.maximum(stats[:, 0], 1)
    raw = np.stack([np.log(n), np.log((stats[:, 1] + 1) / n), *[np.log1p(stats[:, k] * 100 / n) for k in (2, 3, 4)]], 1)
    x = np.round(raw * mcd.FRACTION) / mcd.FRACTION
    good = ~failed
    sizes = Counter((r[2], r[3]) for r, g in zip(rows, good) if g)
    langs = Counter(r[2] for r, g in zip(rows, good) if g)
    far = np.full(len(rows), np.nan)
    for group in sizes:
        own = np.array([g and (r[2], r[3]) == group for r, g in zip(rows, good)])
        if sizes[group] >= mcd.LEAST_ROWS:
            members = own
        elif langs[group[0]] >= mcd.LEAST_ROWS:
            members = np.array([g and r[2] == group[0] for r, g in zip(rows, good)])
        else:
            members = good
        far[own] = brute_estimate(x[members])[own[members]]
    return stats, failed, far


@pytest.mark.parametrize("text", [None, "", " \t\n", "a b c d e", "a b c d e a b c d e", "x " * 40, "x\n\nx\n y\nx", "é*# <b>|$%&é é é é", "a b c d e f g a b c d e f g a b c d e q\nr\nq\nr"])
def test_statistics(spark, text):
    row = mcd.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string"), ("doc_id",)).first()
    assert tuple(row[s] for s in mcd.STATS) == brute_statistics(text)


def test_op3_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    stats, failed, far = brute_judge(rows)
    got = {r["doc_id"]: r for r in queries.op3_robust_outliers(spark, SF001).collect()}
    assert len(got) == len(rows)
    for r, s, f, d in zip(rows, stats, failed, far):
        assert tuple(got[r[0]][c] for c in mcd.STATS) == tuple(s) and got[r[0]]["base_failed"] == f
        if f or abs(d - mcd.CUT) > 1e-3:
            assert got[r[0]]["kept"] == (not f and d <= mcd.CUT)


def test_distances_of_groups_large_and_small(spark):
    rng = np.random.default_rng(0)
    text = lambda n, k, junk: " ".join("w%d%s" % (rng.integers(10**6), "ab" * int(rng.integers(0, k)) + junk) for _ in range(n))
    rows = [(i, text(int(rng.integers(20, 200)), 3, ""), "en", "big") for i in range(150)]
    rows += [(200 + i, text(60, 3, "***"), "en", "big") for i in range(12)]
    rows += [(300 + i, text(50, 6, ""), "en", "little") for i in range(5)] + [(400 + i, text(40, 2, ""), None, None) for i in range(4)]
    rows += [(500, None, "en", "big"), (501, "", None, "big"), (5, rows[5][1], "en", "big"), (502, text(20000, 3, ""), "en", "big"), (None, text(30, 3, ""), "en", None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, key string, d string")
    got = mcd.judge(docs).collect()
    stats, failed, far = brute_judge(rows)
    want = sorted((str(r[0]), *map(int, s), bool(f), None if f else round(float(d), 5)) for r, s, f, d in zip(rows, stats, failed, far))
    assert sorted((str(r["doc_id"]), *[r[s] for s in mcd.STATS], r["base_failed"], None if r["distance"] is None else round(r["distance"], 5)) for r in got) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[200 + i] for i in range(12)) and sum(kept[i] for i in range(150)) >= 148
    assert mcd.judge(docs.limit(0)).collect() == []


def test_a_third_of_copies_is_rejected(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join("w%d%s" % (rng.integers(10**6), "ab" * int(rng.integers(0, 3))) for _ in range(int(rng.integers(60, 200))))
    copy = " ".join(f"w{i}***" for i in range(70))
    rows = [(i, text(), "en", "s") for i in range(120)] + [(1000 + i, copy, "en", "s") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in mcd.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(60)) and sum(got[i] for i in range(120)) >= 114


def test_moderate_outliers_of_each_statistic(spark):
    rng = np.random.default_rng(2)
    words = lambda n: ["w%d%s" % (rng.integers(10**6, 10**7), "ab" * int(rng.integers(0, 3))) for _ in range(n)]
    rows = [(i, " ".join(words(int(rng.integers(80, 160)))), "en", "s") for i in range(150)]
    repeated = words(9)
    odd = {
        "n_words": " ".join(words(900)),
        "word_chars": " ".join(w + "abcdefghi" for w in words(100)),
        "n_symbols": " ".join(words(90) + ["#"] * 10),
        "n_dup_lines": "\n".join([" ".join(words(4)) for _ in range(20)] + ["one"] * 11),
        "n_repeat_words": " ".join(words(42) + repeated + words(40) + repeated),
    }
    rows += [(1000 + k, text, "en", "s") for k, text in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in mcd.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for k, name in enumerate(odd):
        assert not got[1000 + k]["base_failed"] and not got[1000 + k]["kept"], (name, got[1000 + k]["distance"])
    assert sum(got[i]["kept"] for i in range(150)) >= 147

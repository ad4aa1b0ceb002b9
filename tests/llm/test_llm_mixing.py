"""Mixing against a sorted recomputation."""

import hashlib
import re
from fractions import Fraction

import pytest
from quire.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    total = {s: sum(z for z, r in zip(size, rows) if r[2] == s) for s in names}
    target, full = {}, set()
    while True:
        left = Fraction(3 * sum(total.values()), 2) - sum(2 * total[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and free and 2 * total[s] <= left * weight[s] / free}
        if not more:
            break
        full |= more
    target = {s: 2 * total[s] if s in full else left * weight[s] / free for s in names}
    out = []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    h = [int(md5(("" if r[0] is None else str(r[0])) + ":" + md5(r[1] or ""))[:15], 16) for r in rows]
    for s in names:
        base = int(target[s] // total[s]) if total[s] else 0
        budget, taken, extra = target[s] - base * total[s], 0, set()
        for x in sorted({a for a, r in zip(h, rows) if r[2] == s}):
            group = sum(z for z, a, r in zip(size, h, rows) if r[2] == s and a == x)
            if taken + group <= budget or (taken <= budget and taken + group - budget <= budget - taken):
                extra.add(x)
                taken += group
                if taken > budget:
                    break
            else:
                break
        out += [(r[0], z, total[s], round(float(target[s]), 6), z * (base + (a in extra))) for r, z, a in zip(rows, size, h) if r[2] == s]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [0, 400])
def test_mix_equals_brute_force(spark, hot):
    rows = [(i, "w " * (i * 7 % 40), ["a", "b", "Z", None, "é"][i % 5], "x", "y") for i in range(300)]
    rows += [(1000 + i, "v " * (i % 9), "a", "x", "y") for i in range(hot)]
    rows += [(5, "same id twice", "a", "x", "y")] * 3 + [(None, "no id", "b", "x", "y"), (2000, None, "tiny", "x", "y"), (2001, "", "Z", "x", "y"), (2002, "z " * 20000, "long", "x", "y")]
    got = found(mixing.mix(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


@pytest.mark.parametrize("shared", [None, 7])
def test_targets_are_met_where_ids_are_null_or_repeat(spark, shared):
    rows = [(shared, f"text number {i} " + "w " * (i % 11), "abc"[i % 3], "x", "y") for i in range(1500)]
    got = found(mixing.mix(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    for target in {r[3] for r in got}:
        assert abs(sum(r[4] for r in got if r[3] == target) - target) < 0.01 * target


def test_mix_without_words_or_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", "", ""), (2, "  ", None, "", "")], SCHEMA)
    assert [r[4] for r in found(mixing.mix(docs))] == [0, 0]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_repeated_rows_are_the_taken_ones(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), "abc"[i % 3], str(i), "c") for i in range(90)], SCHEMA)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    rows = [r["doc_id"] for r in out.collect()]
    assert {i: rows.count(i) for i in want} == want
    assert mixing.repeated(docs.limit(0)).collect() == []

"""Base spans against the plain patterns; votes, estimate and added spans on a labelled table."""

import hashlib
import random
import re

import numpy as np
import pytest
from quire.llm import pii, queries

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def valid(d):
        d = [int(c) for c in d[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and valid(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_equal_patterns():
    rng = random.Random(4)
    for alphabet in ("a@.b-1 ", "0123456789.. ", "45- 0123456789", "+1 ().-23", "a@b.c+1.2.3.4 5"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_op9_on_whole_table(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = queries.op9_weak_supervision(spark, SF01).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = plain_spans(rows[r["doc_id"]])
        flat = [f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in spans[k]]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [len(spans[k]) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r["spans"].split(","))
    extra = {(r["doc_id"], s) for r in got for s in r["spans"].split(",") if s.startswith("secret")}
    planted = {(i, m.span(1)) for i, t in rows.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert planted and {(i, f"secret:{a}:{b}") for i, (a, b) in planted} <= extra
    plain = [r for r in got if not re.search(r"[0-9@]", rows[r["doc_id"]])]
    assert len(plain) > 100 and all(not r["spans"] for r in plain)


def test_estimate_recovers_reliabilities():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.85, 0.6, 0.7])
    votes = np.where(rng.random((4000, 7)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns, counts = np.unique(np.concatenate((votes, truth[:, None]), 1), axis=0, return_counts=True)
    hit = pii.reliabilities(patterns[:, :7], counts.astype(float))
    accuracy = counts[(hit > 0.5) == (patterns[:, 7] == 1)].sum() / counts.sum()
    assert accuracy > 0.95


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "call +1 (017) 555-7713 or mail a@b.org"), (3, "call +1 (017) 555-7713 or mail a@b.org"), (None, "ip 1.2.3.4 no 1.2.3.999"), (4, "é 4111 1111 1111 1111 " * 3000), (5, "1" * 50_000)]
    return spark.createDataFrame([(*r, "x", "y", len(r[1] or "")) for r in rows], "doc_id long, text string, spans string, n_ip string, n_chars long")


def test_odd_rows(spark, odd):
    got = {r["doc_id"]: r for r in pii.find(odd).collect()}
    assert got[1]["spans"] == got[2]["spans"] == got[5]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["n_ip"] == 1 and got[4]["n_card"] == 3000 and (got[3]["n_email"], got[3]["n_phone"]) == (1, 1)
    assert pii.find(odd.limit(0)).collect() == []


def test_redacted_texts(spark, odd):
    out = pii.redacted(odd)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[3]["text"] == "call [PHONE] or mail [EMAIL]" and rows[3]["n_chars"] == len(rows[3]["text"])
    assert rows[1]["text"] is None and rows[2]["text"] == "" and "[IP]" in rows[None]["text"] and rows[4]["text"].count("[CARD]") == 3000
    assert pii.redacted(odd.limit(0)).collect() == []

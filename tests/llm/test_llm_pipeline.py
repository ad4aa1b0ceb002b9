"""The pipeline on a small table against plain Python, document by document."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import bytecnn, oracles, pii
from quire.llm.tokens import vocabulary
from test_llm_bytecnn import plain_score
from test_llm_simhash import brute_classes, brute_print
from tokenizers import Tokenizer

SF001 = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The small table, and rows of repeated and null ids."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(*COLUMNS)
    texts = [r["text"] for r in docs.where("lang = 'en' AND n_chars BETWEEN 500 AND 3000").orderBy("doc_id").limit(60).collect()]
    first = docs.agg(F.min("doc_id")).first()[0]
    odd = [(first, texts[40][::1] + " and one more ending of its own"), (7_000_001, texts[41].upper()), (7_000_001, " ".join(texts[42].split()[::-1])), (None, " ".join(texts[43].split()[::-1])), (None, None), (7_000_002, ""), (7_000_002, "")]
    extra = spark.createDataFrame([(i, t, "en", "odd", None if t is None else len(t)) for i, t in odd], docs.schema)
    docs.unionByName(extra).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF001}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()]


def same_rows(got, want):
    assert Counter(got) == Counter(want)


def test_every_stage_and_the_whole_run_against_plain_python(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows = rows_of(docs)
    # 1. quality: the plain sums of the fitted network
    net = bytecnn.fit(docs, spark.read.parquet(f"{table}/labels.parquet"))
    good = [r for r in rows if plain_score((r[1] or "").encode(), net) >= 0.3]
    assert 0.5 * len(rows) < len(good) < len(rows)
    # 2. near-duplicates: all pairs; the least (id, text) of a class stays, without an id only if none has one
    prints = [brute_print(r[1]) for r in good]
    classes = {}
    places = list(range(len(good)))
    for r, c in zip(good, brute_classes(places, prints)):
        classes.setdefault(c, []).append(r)
    kept_ids = Counter(min((r[0] is None, r[0]) for r in own)[1] for own in classes.values())
    step1 = corpus_pipeline.STAGES[0][1](spark, docs, table)
    same_rows(rows_of(step1), good)
    unique = spark.createDataFrame(good, docs.schema)
    step2 = rows_of(corpus_pipeline.STAGES[1][1](spark, unique, table))
    assert Counter(r[0] for r in step2) == kept_ids and not Counter(step2) - Counter(good) and len(step2) == len(classes)
    assert sum(len(own) == 1 and own[0] not in step2 for own in classes.values()) == 0
    # 3. personal data: spans of the operator, replaced by hand
    before = spark.createDataFrame(step2, docs.schema)
    model = pii.fit(before)
    clean = []
    for i, text, lang, source, n in step2:
        if text is not None:
            out, at = "", 0
            for k, a, b in sorted(pii.spans_of(text, model)[1], key=lambda x: (x[1], -x[2])):
                if a >= at:
                    out += text[at:a] + f"[{k.upper()}]"
                at = max(at, b)
            text = out + text[at:]
            n = None if n is None else len(text)
        clean.append((i, text, lang, source, n))
    same_rows(rows_of(corpus_pipeline.STAGES[2][1](spark, before, table)), clean)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r[1] or "") for r in clean)
    # 4. mixing: the thresholds of the SQL form (rows without words are taken 0 words whatever their copies)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(clean, docs.schema).toArrow())  # ids stay whole numbers beside nulls
    copies = {}
    for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({oracles.OP4})").fetchall():
        copies[i, size] = taken // size if size else 0
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = rows_of(corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(clean, docs.schema), table))
    want = Counter()
    for r in clean:
        if words(r[1]):
            want[r] += copies[r[0], words(r[1])]
    assert Counter({r: n for r, n in Counter(mixed).items() if words(r[1])}) == +want
    # 5. packing: the tokenizer's own ids, end to end
    tokenizer = Tokenizer.from_file(vocabulary())
    whole = Counter()
    for r in mixed:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        whole[r[0], len(ids) // 4] += len(ids)
    pieces = corpus_pipeline.run(spark, table).collect()
    got, room, seen = Counter(), {}, Counter()
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += 4 * p["length"]
        room.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        seen[bytes(p["ids"])] += p["start"] == 0 and p["length"] == p["doc_tokens"]
    assert got == whole
    for own in room.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and total <= 2048 and total & (total - 1) == 0


def test_empty_table(spark):
    now = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF001)
        assert now.collect() == []

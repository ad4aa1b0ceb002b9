"""Rendezvous hashing against a plain version, and what moves when shards change."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F
from quire.llm import queries, sharding

SF001 = "/root/testdata/sf0.001"


def plain(key, weights):
    def score(s, w):
        digest = hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()
        return math.log((int(digest[:13], 16) + 0.5) / 2**52) / w

    return max(weights, key=lambda s: (score(s, weights[s]), -s))


def test_op13_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op13_rendezvous_shards(spark, SF001).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == plain(r["doc_id"], dict.fromkeys(range(16), 1)) and r["grown_shard"] in (r["shard"], 16)
        assert r["grown_shard"] == plain(r["doc_id"], dict.fromkeys(range(17), 1))
    for shard in {r["shard"] for r in got}:
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])


def test_weights_shares_and_moves(spark):
    keys = spark.range(40000).withColumnRenamed("id", "doc_id")
    weights = {3: 1.0, 4: 2.0, 9: 1.0}
    changes = {"grown": weights | {12: 2.0}, "gone": {3: 1.0, 9: 1.0}, "heavier": weights | {9: 3.0}}
    rows = sharding.dealt(keys, weights=weights)
    for name, other in changes.items():
        rows = sharding.dealt(rows, weights=other, out=name)
    rows = rows.collect()
    share = lambda c, s: sum(r[c] == s for r in rows) / len(rows)
    for c, of in {"shard": weights, **changes}.items():
        for s, w in of.items():
            assert abs(share(c, s) - w / sum(of.values())) < 0.01
    moved = {c: [(r["shard"], r[c]) for r in rows if r["shard"] != r[c]] for c in changes}
    assert {b for _, b in moved["grown"]} == {12} and {a for a, _ in moved["gone"]} == {4} and {b for _, b in moved["heavier"]} == {9}
    assert all(r["shard"] == plain(r["doc_id"], weights) for r in rows[:300])


def test_odd_rows(spark):
    rows = [(None, None, 1)] * 3 + [(None, "a", 2)] + [(5, "x" * 300000, 3), (5, "", 4), (5, "", 4), (6, None, 5), (7, "ü\0", 6)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int, slot int")
    got = sharding.assign(docs).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"]), r["size"]) for r in got) == sorted(((i is not None, i), len((t or "").encode()) + 1) for i, t, _ in rows)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1 == len({r["shard"] for r in got if r["doc_id"] == 5})
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.assign(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [1.0, 0.0])
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [])


def test_written_shards_read_back(spark, scratch):
    docs = spark.createDataFrame([(i % 50, f"t{i}", i) for i in range(200)], "doc_id long, text string, extra int")
    sharding.write_shards(docs, f"{scratch}/shards", [1, 2, 3])
    back = spark.read.parquet(f"{scratch}/shards")
    assert sorted((r["doc_id"], r["text"], r["extra"]) for r in back.collect()) == sorted((i % 50, f"t{i}", i) for i in range(200))
    assert all(r["shard"] == plain(r["doc_id"], {0: 1, 1: 2, 2: 3}) for r in back.collect())

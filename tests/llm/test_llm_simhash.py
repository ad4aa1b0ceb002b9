"""SimHash fingerprints, tree search and components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from quire.llm import queries, simhash
from quire.llm.graph import components

SF001 = "/root/testdata/sf0.001"


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(ids))]


def test_fingerprint():
    for text in [None, "", "One", "a b", "a b c d", "A b\tC\nd e É f g É", "x " * 5000]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_op7_on_whole_table(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_classes([i for i, _ in rows], prints))]
    assert sorted(map(tuple, queries.op7_simhash_vantage_tree(spark, SF001).collect())) == want


@pytest.mark.parametrize("shard_size", [5, 1000])
def test_links_equal_all_pairs(spark, monkeypatch, shard_size):
    monkeypatch.setattr(simhash.Tree.of, "__defaults__", (shard_size,))
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for p in list(prints)[:60]:  # chains of near prints, and a dense group
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.add(p)
    dense = rng.getrandbits(64)
    prints |= {dense ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    forest = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)).collect()
    assert len(forest) < 12 * len(prints)
    classes = brute_classes(list(range(len(prints))), prints)
    at = {s: k for k, s in enumerate(signed)}
    assert all(classes[at[r["u"]]] == classes[at[r["v"]]] for r in forest)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(forest, "u long, v long")).collect()}
    got = [roots.get(s, s) for s in signed]
    least = {}
    for s, c in zip(signed, classes):
        least[c] = min(least.get(c, s), s)
    assert got == [least[c] for c in classes]


def test_small_shards_really_split():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    tree = simhash.Tree(int(prints[0]), [[8]] * 8, 4)
    counts = np.array([[(tree.distances(prints)[:, j] == d).sum() for d in range(9)] for j in range(8)])
    tree = simhash.Tree.of(counts, 4000, int(prints[0]), 4, 20)
    who, shard, home = tree.visits(prints)
    assert home.sum() == 4000 and len(np.unique(shard[home])) > 100
    assert len(who) < 4000 * len(np.unique(shard)) / 4


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 2000 + i) for i in range(200)] + [(2000 + i, 900) for i in range(3)]
    rows = components(spark.createDataFrame(chain + star + [(7, 7), (-5, -5)] + chain, "u long, v long")).collect()
    want = {i: 0 for i in range(61)} | {1000: 900, 900: 900} | {2000 + i: 900 for i in range(200)} | {-5: -5}
    assert {r["node"]: r["root"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


SCHEMA = "doc_id long, text string, fp string, part string, best string"


def test_one_of_each_on_odd_rows(spark):
    long = "some words that repeat in a very long text " * 3000
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (3, "A B C D E F G"), (8, None), (6, ""), (9, long), (11, long + "end"), (None, "a b c d e f g"), (None, "quite another thing altogether here"), (12, "alone among the others in this table")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_classes([i for i, _ in rows], prints))), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("3", rows[2][1]), ("6", ""), ("9", long), ("None", rows[8][1]), ("12", rows[9][1])])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "p q r s t", "x", "y", "z"), (1, "p q r s t", "x", "y", "z"), (1, "other words entirely so far away", "x", "y", "z")], SCHEMA)
    kept = sorted(r["text"] for r in simhash.one_of_each(twice).collect())
    assert kept == ["other words entirely so far away", "p q r s t"]
    shared = spark.createDataFrame([(5, "a b c d e f g", "x", "y", "z"), (5, "what else there is to say of it", "x", "y", "z"), (6, "What ELSE there is to say of it", "x", "y", "z")], SCHEMA)
    assert sorted((r["doc_id"], r["text"][:6]) for r in simhash.one_of_each(shared).collect()) == [(5, "a b c "), (5, "what e")]


@pytest.mark.parametrize("bits,seconds", [(3, 60), (5, 120)])
def test_a_shard_of_many_distinct_near_copies(bits, seconds):
    """100,000 prints around one centre: neither all pairs are compared nor held."""
    import time
    import tracemalloc

    rng = np.random.default_rng(bits)
    flips = np.uint64(1) << rng.integers(0, 64, (100_000, bits)).astype(np.uint64)
    prints = np.unique(np.uint64(0x0123456789ABCDEF) ^ np.bitwise_xor.reduce(flips, axis=1))
    visitors = prints[::3] ^ np.uint64(1 << 40)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int64)), pa.array(np.full(len(p), own)), pa.array(p.view(np.int64))], ["shard", "own", "fp"]) for p, own in ((prints, True), (visitors, False))]
    tracemalloc.start()
    began = time.time()
    links = np.concatenate([np.stack((b.column("u").to_numpy(), b.column("v").to_numpy()), 1) for b in simhash._search(4)(iter(batches))])
    took, most = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < seconds and most < 400 << 20
    nodes, at = np.unique(links, return_inverse=True)
    forest = simhash.Forest(len(nodes))
    forest.unite(*at.reshape(-1, 2).T)
    assert len(np.unique(forest.roots(np.arange(len(nodes))))) == 1 and np.isin(prints, nodes.view(np.uint64)).all() and len(links) < 2 * (len(prints) + len(visitors))

"""Token encoding, grammar compression and packing against plain encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from quire.llm import grammar, packing, queries, tokens
from quire.llm.common import stored
from quire.llm.tokens import Encoder, vocabulary

SF001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, start string"
ODD = [(5, "a b a b a b " * 4000, "x", "y"), (2, None, None, None), (7, "", "x", "y"), (9, "  \t\n", "x", "y"), (5, "same id", "x", "y"), (5, "same id", "x", "y"), (None, "no id", "x", "y"), (1, "é <|endoftext|> İ.* ok!!", "x", "y")]


@pytest.fixture(scope="module")
def words():
    return Encoder(vocabulary())


def plain(words, text, end):
    return [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_tokenizer(words):
    rng = random.Random(1)
    letters = " \t\n ab'sé.,*<|endoftext>İ≠éΣ1٣$|̸=́क़"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.1:
            text += rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|"])
        ids, n = words.encode(pa.array([text, None, "x", text]))
        one = plain(words, text, 0)[:-1]
        assert n.tolist() == [len(one), 0, n[2], len(one)]
        assert ids.tolist() == one + ids[n[0] : n[0] + n[2]].tolist() + one


def test_frequent_words_are_encoded_once_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED_WORDS", 400)
    words, asked = Encoder(vocabulary()), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split(" "))
            return whole.encode_batch_fast(texts, **options)

    whole, words.tokenizer = words.tokenizer, Counted()
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcdefghéß") for _ in range(12))
    frequent = [name() for _ in range(100)] + ["555-7228", "(988)", "it's"]
    for _ in range(20):
        texts = [" ".join(rng.sample(frequent + [name() for _ in range(90)], 193)) for _ in range(2)]
        ids, n = words.encode(pa.array(texts))
        assert len(words.known) <= 400 + 300
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) > 2000 and all(asked.count(w) == 1 for w in frequent)


def test_texts_with_special_tokens_take_their_places(words, monkeypatch):
    asked, look = [], words._words
    monkeypatch.setattr(words, "_words", lambda found: asked.append(len(found)) or look(found))
    texts = ["<|endoftext|> a b", "<|x", "it is.", None, "", "<|startoftext|><|endoftext|>", "é is <|", "a b", "<|"] * 20
    ids, n = words.encode(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [plain(words, t, 0)[:-1] for t in texts]
    assert len(asked) == 1  # words are looked up once a slice
    ids, n = words.encode(pa.array(["<|", None]))
    assert ids.tolist() == plain(words, "<|", 0)[:-1] and n.tolist() == [len(ids), 0]


def test_words_that_normalisation_leaves_alone_are_not_normalised():
    from tokenizers import Tokenizer

    words, whole, raw, steps = Encoder(vocabulary()), Tokenizer.from_file(vocabulary()), [], []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            tokenizer.normalizer, tokenizer.pre_tokenizer = self.normalizer, self.pre_tokenizer
            steps.append(self.normalizer)
            if self.normalizer is None:
                raw.extend(w for t in texts for w in t.split(" "))
            return tokenizer.encode_batch_fast(texts, **options)

    tokenizer, words.tokenizer = words.tokenizer, Watched()
    rng = random.Random(5)
    name = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    ready = [name("abcdefgxyzßàéñöøýÿ") for _ in range(3000)] + ["...", "?!", "#"]
    others = [name("abÀÉÞ×÷İΣжЖ一e\u0301ﬁſKÅ'7-_") for _ in range(2000)] + ["it's", "'s", "don't", "ÿ\u0308"]
    mixed = rng.sample(ready + others, len(ready) + len(others))
    texts = [" ".join(mixed[at : at + 7]) for at in range(0, len(mixed), 7)] + mixed
    ids, n = words.encode(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(ready) <= set(raw) and any(s is not None for s in steps)
    assert words.tokenizer.normalizer is not None


def test_pairs_that_share_a_cell_are_told_apart():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 40_000).astype(np.uint64)
    pairs = np.unique(keys[:20_000])
    asked = rng.permutation(np.concatenate((keys, pairs)))
    assert len(np.unique(grammar._cells(pairs))) < len(pairs)
    for some in (pairs, pairs[:1], pairs[:0]):
        number = {p: k for k, p in enumerate(some.tolist())}
        assert grammar._places(some, asked, grammar._cells(asked)).tolist() == [number.get(k, -1) for k in asked.tolist()]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, rng.integers(1, 400)) for _ in range(60)] + [np.array([7] * 5000), np.array([1])]
    ids, n = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    block = grammar.compress(ids, n)
    assert len(block["symbols"]) < len(ids) / 2 and len(block["rule_left"])
    reader = grammar.Grammar(block)
    assert (reader.expand(reader.symbols) == ids).all()
    for k, d in enumerate(docs):
        assert (reader.document(k) == d).all()
        a, b = sorted(rng.integers(0, len(d) + 1, 2).tolist())
        if a < b:
            assert (reader.tokens(k, a, b) == d[a:b]).all()


def test_small_or_unrepeated_input_has_no_rules():
    block = grammar.compress(np.arange(9, dtype=np.uint32), np.array([4, 5]))
    assert not len(block["rule_left"]) and (block["symbols"] == np.arange(9)).all()


def check_encoded(words, rows, found):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [f["doc_id"] for f in found] == [r[0] for r in order]
    start = 0
    for f in found:
        assert f["start"] == start
        start += f["n_tokens"]
    want = sorted((str(r[0]), len(x := plain(words, r[1], 2)), crc(x)) for r in rows)
    assert sorted((str(f["doc_id"]), f["n_tokens"], zlib.crc32(f["ids"])) for f in found) == want


def test_grammar_file_on_odd_rows(spark, words):
    docs = spark.createDataFrame(ODD, SCHEMA)
    blocks = stored(grammar.grammar_blocks(docs, block_tokens=1000))
    check_encoded(words, ODD, grammar.read_grammar(blocks).orderBy("start").collect())
    assert grammar.encoded_documents(docs.limit(0)).collect() == []


def test_op1_on_whole_table(spark, words):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    start, want = 0, []
    for i, t in sorted(rows):
        ids = plain(words, t, 2)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_repair_grammar(spark, SF001).collect())) == want


def check_packed(words, rows, pieces, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] == len(p["ids"]) // 4 > 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        total = 0
        for p in own:
            assert p["offset"] == total
            total += p["length"]
        assert total <= capacity and total & (total - 1) == 0  # no padding at all
    got = sorted((str(p["doc_id"]), p["start"], p["ids"]) for p in pieces)
    whole = sorted((str(r[0]), np.array(plain(words, r[1], 1), "<u4").tobytes()) for r in rows)
    if len({r[0] for r in rows}) == len(rows):
        joined = {}
        for i, s, raw in got:
            assert s * 4 == len(joined.get(i, b""))
            joined[i] = joined.get(i, b"") + raw
        assert sorted(joined.items()) == whole
    assert sum(len(x) for *_, x in got) == sum(len(x) for _, x in whole)


@pytest.mark.parametrize("capacity", [16, 128, 2048])
def test_packing_odd_rows(spark, words, capacity):
    docs = spark.createDataFrame(ODD, SCHEMA)
    check_packed(words, ODD, packing.pack_documents(docs, capacity).collect(), capacity)
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_op2_on_whole_table(spark, words):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = packing.pack_documents(docs).collect()
    check_packed(words, rows, pieces, 2048)
    query = queries.op2_harmonic_packing(spark, SF001).collect()
    assert sorted((p["doc_id"], p["start"], p["ids_crc32"]) for p in query) == sorted((p["doc_id"], p["start"], zlib.crc32(p["ids"])) for p in pieces)


def test_classes_hold_a_fixed_count():
    """Without stuffing every full bin waits; then it has exactly as many documents as its class says."""
    rng = np.random.default_rng(0)
    packer = packing.Packer(2048, waiting=10**6)
    for doc in range(3000):
        packer.add(doc, bytes(4 * int(rng.integers(1, 2049))))
    bins = [p for *_, p in packer.waiting]
    kinds = [{packing.class_of(len(x[2]) // 4, 2048) for x in own} for own in bins]
    assert len(bins) > 1000 and all(len(k) == 1 and len(own) == k.pop() for k, own in zip(kinds, bins))
    assert packing.class_of(1, 2048) == 32 and packing.class_of(683, 2048) == 2 and packing.class_of(682, 2048) == 3 and packing.class_of(2048, 2048) == 1
    with pytest.raises(ValueError):
        packing.Packer(1000)


def test_few_documents_are_cut_and_nothing_is_padded(spark):
    """On the table most documents that fit stay whole, and so they do where no document is long."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    pieces = packing.pack_documents(docs).drop("ids").collect()
    fit = [p for p in pieces if p["doc_tokens"] <= 2048]
    assert sum(p["length"] == p["doc_tokens"] for p in fit) > 0.95 * len({p["doc_id"] for p in fit})
    rng = np.random.default_rng(1)
    packer = packing.Packer(2048, waiting=64)
    lengths = rng.integers(1, 1500, 4000)
    for doc, n in enumerate(lengths):
        packer.add(doc, bytes(4 * int(n)))
        assert len(packer.waiting) <= 65 and packer.stuffed <= 64 * 2048
    packer.flush()
    done, sizes = packer.take(), {}
    for p in done:
        sizes[p[5]] = sizes.get(p[5], 0) + p[2]
    assert sum(sizes.values()) == lengths.sum() and sum(n != 2048 for n in sizes.values()) <= 11 and all(n & (n - 1) == 0 for n in sizes.values())
    assert sum(p[2] == p[4] for p in done) > 0.8 * len(lengths)

"""Re-Pair grammar compression of token ids, with random-access decoding.

Documents in ascending id order are cut into shards by range, and a shard into blocks of whole
documents with about ``BLOCK_TOKENS`` ids. Each block has a grammar of its own: pairs of adjacent
symbols that are frequent become rules, level after level, until no pair is frequent any more. A
level takes all pairs that occur at least an eighth as often as the most frequent one. Overlapping
occurrences are replaced from left to right, and no pair spans two documents. So a document is a
range of symbols, and the expansion lengths of the rules tell where any of its ids lie.

File format: a Parquet table with a row per block: ``shard, block, first_token`` (ids of the
shard before the block), ``n_tokens, doc_ids, doc_symbols`` (symbols per document), and as
little-endian unsigned 32-bit integers ``symbols, rule_left, rule_right, rule_length``
(expansion lengths) and ``levels`` (rules per level). Symbols below ``base`` are ids, ``base + r`` is rule r.

Null texts and empty texts hold the end id only. Rows with a null id come first; repeated
ids are ordered by the text's hash, then by the text. Memory is bounded by a block or by the
longest document. An empty table gives an empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored
from .tokens import encoder, slices, vocabulary, with_end

BLOCK_TOKENS = 1 << 18
MIN_COUNT = 8
BASE = 1 << 20

BLOCK_SCHEMA = (
    "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_symbols array<int>, "
    "symbols binary, rule_left binary, rule_right binary, rule_length binary, levels binary"
)
DOC_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids binary"


def _cells(keys: np.ndarray) -> np.ndarray:
    """A number below 2^18 for each pair."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)


def _places(pairs: np.ndarray, keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The keys' places in the sorted ``pairs``, -1 where a key is none of them. ``cells``: those of the keys."""
    if not len(pairs):
        return np.full(len(keys), -1)
    last, number = np.zeros(1 << 18, np.int64), np.arange(len(pairs))
    last[_cells(pairs)] = number
    which = last[cells]
    which[pairs[which] != keys] = -1
    hidden = np.flatnonzero(last[_cells(pairs)] != number)  # a later pair has their cell
    if len(hidden):
        rest = np.flatnonzero(which < 0)
        near = hidden[np.searchsorted(pairs[hidden[:-1]], keys[rest])]
        found = pairs[near] == keys[rest]
        which[rest[found]] = near[found]
    return which


def compress(ids: np.ndarray, n: np.ndarray, min_count: int = MIN_COUNT, base: int = BASE) -> dict:
    """Grammar of the documents whose ids lie end to end in ``ids``, ``n`` of each (at least one)."""
    symbols = ids.astype(np.uint64)
    starts = np.cumsum(n) - n
    rules: list[tuple[np.ndarray, np.ndarray]] = []
    n_rules, least = 0, None
    while len(symbols) > 1:
        keys = (symbols[:-1] << np.uint64(32)) | symbols[1:]
        cells = _cells(keys)
        across = starts[1:] - 1  # pairs of two documents
        count = np.bincount(cells, minlength=1 << 18)
        np.subtract.at(count, cells[across], 1)
        top = int(count.max())
        if top < min_count:
            break
        least = max(min_count, min(top // 8, least // 2 if least else top))
        frequent = (count >= least)[cells]  # a superset: pairs may share a cell
        frequent[across] = False
        at = np.flatnonzero(frequent)
        pairs, count = np.unique(keys[at], return_counts=True)
        pairs = pairs[count >= least]
        which = _places(pairs, keys[at], cells[at])
        marked = np.flatnonzero(which >= 0)
        at, which = at[marked], which[marked]
        # in a run of adjacent marked places every second one is taken
        place = np.arange(len(at))
        new_run = np.ones(len(at), bool)
        new_run[1:] = np.diff(at) != 1
        taken = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
        at, which = at[taken], which[taken]
        uses = np.bincount(which, minlength=len(pairs))
        useful = uses >= 2
        good = useful[which]
        at, which = at[good], which[good]
        if not len(at):
            if least == min_count:
                break
            continue
        number = np.cumsum(useful) - 1
        chosen = pairs[useful]
        symbols[at] = (number[which] + (base + n_rules)).astype(np.uint64)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, starts = symbols[keep], starts - np.searchsorted(at, starts)  # a document's first symbol is never the second of a pair
        rules.append(((chosen >> np.uint64(32)).astype(np.uint32), (chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        n_rules += len(chosen)
    left = np.concatenate([x for x, _ in rules] or [np.zeros(0, np.uint32)])
    right = np.concatenate([x for _, x in rules] or [np.zeros(0, np.uint32)])
    levels = np.array([len(x) for x, _ in rules], np.uint32)
    length = np.ones(len(left), np.int64)
    size = lambda s, upto: np.where(s < base, 1, length[:upto][np.maximum(s.astype(np.int64) - base, 0)] if upto else 1)
    done = 0
    for k in levels.tolist():
        length[done : done + k] = size(left[done : done + k], done) + size(right[done : done + k], done)
        done += k
    return {
        "symbols": symbols.astype(np.uint32), "rule_left": left, "rule_right": right, "rule_length": length.astype(np.uint32),
        "levels": levels, "doc_symbols": np.diff(np.append(starts, len(symbols))).astype(np.int32),
    }


class Grammar:
    """Reader of a block. ``block``: the arrays of ``compress``."""

    def __init__(self, block: dict, base: int = BASE):
        self.base, self.symbols = base, block["symbols"]
        self.left, self.right = block["rule_left"], block["rule_right"]
        self.length = block["rule_length"].astype(np.int64)
        self.doc_end = np.cumsum(block["doc_symbols"].astype(np.int64))
        self.first = np.cumsum(self.length) - self.length  # where a rule's expansion lies in self.flat
        self.flat = np.zeros(int(self.length.sum()), np.uint32)
        done = 0
        for k in block["levels"].tolist():
            now = slice(done, done + k)
            both = np.stack((self.left[now], self.right[now]), 1).ravel()
            self.flat[self.first[done] : self.first[done] + self.length[now].sum()] = self.expand(both)
            done += k

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.length[symbols[rule].astype(np.int64) - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        rule = symbols >= self.base
        if not rule.any():
            return symbols.astype(np.uint32)
        n = self.sizes(symbols)
        ends = np.cumsum(n)
        first = np.zeros(len(symbols), np.int64)
        first[rule] = self.first[symbols[rule].astype(np.int64) - self.base]
        out = self.flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
        out[(ends - n)[~rule]] = symbols[~rule]
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the block's document k; the others are not expanded."""
        return self.expand(self.symbols[self.doc_end[k - 1] if k else 0 : self.doc_end[k]])

    def tokens(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.doc_end[k - 1] if k else 0 : self.doc_end[k]]
        ends = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : stop - skipped]


def _blocks(path: str, end: int, block_tokens: int, min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = encoder(path), TaskContext.get().partitionId()
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = block = first = 0

        def close() -> pa.RecordBatch:
            nonlocal kept, size, block, first
            n = np.concatenate([x[2] for x in kept])
            g = compress(np.concatenate([x[1] for x in kept]), n, min_count)
            row = {"shard": shard, "block": block, "first_token": first, "n_tokens": int(n.sum()), "doc_ids": [i for x in kept for i in x[0]], "doc_symbols": g.pop("doc_symbols")}
            row |= {k: v.astype("<u4").tobytes() for k, v in g.items()}
            kept, size, block, first = [], 0, block + 1, first + row["n_tokens"]
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in ARROW_BLOCK], schema=ARROW_BLOCK)

        for batch in batches:
            for part in slices(batch):
                ids, n = with_end(*words.encode(part.column("text")), end)
                docs, ends = part.column("doc_id").to_pylist(), np.cumsum(n)
                at = 0
                while at < len(n):  # a block ends with the document that fills it
                    before = int(ends[at - 1]) if at else 0
                    stop = min(len(n), int(np.searchsorted(ends, before + block_tokens - size, "left")) + 1)
                    kept.append((docs[at:stop], ids[before : ends[stop - 1]], n[at:stop]))
                    size += int(ends[stop - 1]) - before
                    if size >= block_tokens:
                        yield close()
                    at = stop
        if kept:
            yield close()

    return run


ARROW_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int32()))]
    + [(k, pa.binary()) for k in ("symbols", "rule_left", "rule_right", "rule_length", "levels")]
)
ARROW_DOC = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
            arrays = {k: np.frombuffer(row[k], "<u4") for k in ("symbols", "rule_left", "rule_right", "rule_length", "levels")}
            g = Grammar(arrays | {"doc_symbols": np.array(row["doc_symbols"], np.int64)})
            ids = g.expand(g.symbols)
            symbol_ends = np.cumsum(g.sizes(g.symbols))
            ends = symbol_ends[g.doc_end - 1]
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            n = np.diff(np.concatenate(([0], ends)))
            offsets = pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n + row["first_token"]), pa.array(n), pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, raw])],
                schema=ARROW_DOC,
            )


def write_grammar(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, block_tokens: int = BLOCK_TOKENS, min_count: int = MIN_COUNT) -> None:
    """Encode ``docs(doc_id, text)`` and write the compressed blocks to ``path`` as Parquet."""
    ready(docs.sparkSession)
    grammar_blocks(docs, tokenizer, end, block_tokens, min_count).write.parquet(path)


def grammar_blocks(docs: DataFrame, tokenizer: str | None = None, end: int = 2, block_tokens: int = BLOCK_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """The blocks as rows. Shards are ranges of document ids, so a shard's number tells its place."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    shards = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return shards.select("doc_id", "text").mapInArrow(_blocks(tokenizer or vocabulary(), end, block_tokens, min_count), BLOCK_SCHEMA)


def read_grammar(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document of the
    blocks. ``start``: ids of all documents before it. What is broadcast has a row per shard, and
    shards are as many as shuffle partitions."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before = [0, *accumulate(r["n"] for r in totals)]
    spark = blocks.sparkSession
    starts = spark.createDataFrame([(r["shard"], b) for r, b in zip(totals, before, strict=False)], "shard int, _before long")
    docs = blocks.mapInArrow(_documents, DOC_SCHEMA)
    return docs.join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_start") + F.col("_before")).alias("start"), "n_tokens", "ids")


def encoded_documents(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Write the documents' blocks to the shared folder and read them back."""
    ready(docs.sparkSession)
    return read_grammar(stored(grammar_blocks(docs, tokenizer, end)))

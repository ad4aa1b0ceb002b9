"""SimHash near-duplicates with a vantage-point tree over the fingerprints.

Fingerprints: lower-cased A-Z, words, shingles of ``width`` words joined by a space and counted as
often as they occur (a shorter text is one shingle; a text without words has fingerprint 0 and is
linked like any other), XXH64 of each, and a bit for every place set in over half of them.
A null text has no words.

Links: two fingerprints at ``radius`` or fewer differing bits. Equal fingerprints are
one node, so a group of copies costs one row whatever its size. The distinct fingerprints go through
a tree with a vantage point per level. A level compares one block of the bits: the Hamming distance
of that block to the vantage point's puts a fingerprint into one of the level's rings, and the rings
of all levels name its shard. As the blocks are disjoint, the differences of two fingerprints'
block distances add up to at most their Hamming distance (triangle inequality per level). A query
therefore enters a branch only while the distances to the ring boundaries it crosses add up to
``radius`` or less. Each fingerprint is stored in its own shard and visits later shards within
that bound; so each pair meets once. The number of rings follows the number of fingerprints, to
keep shards at about ``SHARD_SIZE``. Inside a shard a smaller vantage-point tree with median
splits leads to leaves, where all bits are compared; prints that are in one set already, first of all those around the vantage
points of dense balls, aren't compared again. A shard returns a spanning forest of its
links, never all pairs of a group, and components of the forest are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, same, stored
from .graph import components

SEED, BITS, BLOCKS = 42, 64, 8
SHARD_SIZE, LEAF, QUERY_ROWS, STARS = 1000, 256, 4096, 64
HOT_PRINTS = 20_000  # at most so many fingerprints have over 1 / HOT_PRINTS of all rows


def fingerprint(text: str | None, width: int = 4) -> int:
    """Fingerprint of a whole text as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, BITS)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints)], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, text_hash, fp`` (the 64 bits as long) of each row of ``docs(doc_id, text)``."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_fingerprints(width), "doc_id long, text_hash long, fp long")


class Tree:
    """Levels of the shard tree. ``rings[j]``: the block distances at which level j's rings end (inclusive)."""

    def __init__(self, vantage: int, rings: list[list[int]], radius: int):
        self.vantage, self.rings, self.radius = vantage, rings, radius

    @staticmethod
    def of(counts: np.ndarray, n: int, vantage: int, radius: int, shard_size: int = SHARD_SIZE) -> Tree:
        """Rings of about equal counts. ``counts[j][d]``: fingerprints at block distance d on level j."""
        width, want = BITS // BLOCKS, [1] * BLOCKS
        while np.prod(np.array(want, float)) * shard_size < n and min(want) <= width:
            want[want.index(min(want))] += 1
        rings = []
        for j, k in enumerate(want):
            share = np.cumsum(counts[j]) / max(1, counts[j].sum())
            cuts = sorted({int(np.searchsorted(share, (i + 1) / k - 0.15 / k)) for i in range(k - 1)})
            rings.append([c for c in cuts if c < width] + [width])
        return Tree(vantage, rings, radius)

    def distances(self, prints: np.ndarray) -> np.ndarray:
        differ = prints ^ np.uint64(self.vantage)
        width = BITS // BLOCKS
        return np.stack([np.bitwise_count((differ >> np.uint64(j * width)) & np.uint64((1 << width) - 1)) for j in range(BLOCKS)], 1).astype(np.int64)

    def visits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which print goes to which shard: its place in ``prints``, the shard, and whether it is its own."""
        distance = self.distances(prints)
        who, shard, spent = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
        home = np.zeros(len(prints), np.int64)
        for j, ends in enumerate(self.rings):
            d, starts = distance[:, j], [0, *[e + 1 for e in ends[:-1]]]
            home = home * len(ends) + np.searchsorted(ends, d)
            parts = []
            for ring, (low, high) in enumerate(zip(starts, ends, strict=True)):
                cost = spent + np.maximum(np.maximum(low - d[who], d[who] - high), 0)
                near = cost <= self.radius
                parts.append((who[near], shard[near] * len(ends) + ring, cost[near]))
            who, shard, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
            later = shard >= home[who]  # a shard before the own one meets this print as a visitor
            who, shard, spent = who[later], shard[later], spent[later]
        return who, shard, shard == home[who]


class Forest:
    """Union of nodes 0 .. n-1; ``unite`` returns the links that joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[nodes]
            if (up == nodes).all():
                return nodes
            self.parent[nodes] = self.parent[up]
            nodes = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = [], []
        while len(a):
            a, b = self.roots(a), self.roots(b)
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            if len(a):
                order = np.lexsort((a, b))
                first = np.concatenate(([True], b[order][1:] != b[order][:-1]))
                child, parent = b[order][first], a[order][first]
                self.parent[child] = parent
                low.append(parent)
                high.append(child)
        return np.concatenate([*low, a[:0]]), np.concatenate([*high, a[:0]])


def united(stock: np.ndarray, asked: np.ndarray, offset: int, forest: Forest, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unites prints within the radius: places in ``stock`` with places in ``asked``, which are nodes from ``offset`` on. Yields the links that
    joined two sets.

    Stars first: a few vantage points are linked with all prints within the radius of them, so of a dense ball of prints nearly all
    are one set after as many comparisons as there are prints. Then a vantage-point tree over ``stock`` with median splits, whose branches and leaves
    leave out the pairs that are in one set already: those can't join anything. At most ``LEAF`` by ``QUERY_ROWS`` pairs are compared at once."""
    if not len(stock) or not len(asked):
        return
    for v in np.linspace(0, len(stock) - 1, min(STARS, len(stock) // LEAF)).astype(np.int64):
        rays = [np.flatnonzero(np.bitwise_count(side ^ stock[v]) <= radius) + first for side, first in ((stock, 0), (asked, offset))]
        ends = np.concatenate(rays)
        yield forest.unite(np.full(len(ends), v), ends)
    todo = [(np.arange(len(stock)), np.arange(len(asked)))]
    while todo:
        s, q = todo.pop()
        if not len(s) or not len(q):
            continue
        set_s, set_q = forest.roots(s), forest.roots(q + offset)
        if (set_s == set_s[0]).all():
            q = q[set_q != set_s[0]]
        elif (set_q == set_q[0]).all():
            s = s[set_s != set_q[0]]
        if not len(s) or not len(q):
            continue
        if len(s) > LEAF:
            vantage = stock[s[0]]
            ds, dq = np.bitwise_count(stock[s] ^ vantage).astype(np.int64), np.bitwise_count(asked[q] ^ vantage).astype(np.int64)
            middle = int(np.partition(ds, len(ds) // 2)[len(ds) // 2])
            middle = middle if (ds > middle).any() else middle - 1
            if (ds <= middle).any():
                todo.append((s[ds <= middle], q[dq <= middle + radius]))
                todo.append((s[ds > middle], q[dq > middle - radius]))
                continue
        for at in range(0, len(s), LEAF):
            part = s[at : at + LEAF]
            for first in range(0, len(q), QUERY_ROWS):
                own, other = part, q[first : first + QUERY_ROWS]
                sets = forest.roots(own)
                common = int(np.bincount(sets - sets.min()).argmax() + sets.min())
                there = forest.roots(other + offset)
                for rows, cols in ((own[sets == common], other[there != common]), (own[sets != common], other)):
                    if len(rows) and len(cols):
                        i, j = np.nonzero(np.bitwise_count(stock[rows][:, None] ^ asked[cols][None, :]) <= radius)
                        if len(i):
                            yield forest.unite(rows[i], cols[j] + offset)


def _search(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    class Shard:
        def __init__(self, stock: np.ndarray):
            self.stock, self.forest = stock, Forest(len(stock))

        def ask(self, asked: np.ndarray | None) -> pa.RecordBatch | None:
            """Links among the stock (asked: None), or with visitors."""
            n, out = len(self.stock), []
            own = asked is None
            prints = self.stock if own else np.concatenate((self.stock, asked))
            forest = self.forest if own else Forest(0)
            if not own:
                forest.parent = np.concatenate((self.forest.parent, np.arange(n, len(prints))))
            for a, b in united(self.stock, self.stock if own else asked, 0 if own else n, forest, radius):
                if len(a):
                    out.append((prints[a], prints[b]))
            self.forest.parent = forest.roots(np.arange(len(prints)))[:n]
            if out:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock: list[np.ndarray] = []
        shard, now = None, None

        def ready_shard() -> Iterator[pa.RecordBatch]:
            nonlocal shard, stock
            shard, stock = Shard(np.concatenate(stock)), []
            if (links := shard.ask(None)) is not None:
                yield links

        for batch in batches:  # by shard, its own prints first
            shards, own = batch.column("shard").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(own.astype(np.int8)) != 0)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != now:
                    if stock:
                        yield from ready_shard()
                    shard, stock, now = None, [], shards[a]
                if own[a]:
                    stock.append(prints[a:b])
                    continue
                if stock:
                    yield from ready_shard()
                for at in range(a, b if shard else a, QUERY_ROWS):  # a shard without prints of its own has no links
                    if (links := shard.ask(prints[at : min(b, at + QUERY_ROWS)])) is not None:
                        yield links
        if stock:
            yield from ready_shard()

    return run


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """A spanning forest ``u, v`` of the links between the distinct fingerprints ``prints(fp)``."""
    width = BITS // BLOCKS
    head = prints.agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("v")).first()
    if not head["n"]:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    block = [F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.lit(head["v"])), j * width).bitwiseAND(F.lit((1 << width) - 1))) for j in range(BLOCKS)]
    row = prints.agg(*[F.sum((b == d).cast("long")) for b in block for d in range(width + 1)]).first()
    tree = Tree.of(np.array(row, float).reshape(BLOCKS, width + 1), head["n"], head["v"] & ((1 << BITS) - 1), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                own = batch.column("fp").slice(at, 2000).to_numpy().view(np.uint64)
                who, shard, home = tree.visits(own)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), pa.array(own[who].view(np.int64))], ["shard", "own", "fp"])

    routed = prints.select("fp").mapInArrow(route, "shard long, own boolean, fp long")
    return routed.repartition("shard").sortWithinPartitions("shard", F.col("own").desc(), "fp").mapInArrow(_search(radius), "u long, v long")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(slim: DataFrame, radius: int = 4) -> DataFrame:
    """``fp, root, copies`` of each distinct fingerprint of ``slim(fp)``: the least fingerprint that links lead to, and its number of rows. Stored."""
    nodes = stored(slim.groupBy("fp").agg(F.count("*").alias("copies")))
    linked = stored(components(links(nodes.select("fp"), radius)))
    return stored(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "copies"))


def with_class(slim: DataFrame, named: DataFrame, columns: list[str]) -> DataFrame:
    """``slim`` with the ``columns`` that ``named(fp, copies)`` has for its fingerprint. The fingerprints of most rows, of which there are ``HOT_PRINTS`` at
    most whatever the input, are broadcast; so in the join by fingerprint no group of copies is larger than a small share of all rows."""
    n = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > F.lit(max(1, n // HOT_PRINTS))
    few = F.broadcast(named.where(hot).select("fp", *columns))
    rest = slim.join(few.select("fp"), "fp", "left_anti").join(named.where(~hot).select("fp", *columns), "fp")
    return slim.join(few, "fp").unionByName(rest)


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.
    ``component_id``: the smallest doc_id that links lead to, itself included; null only where all of
    them are null. Repeated rows are kept as often as they occur."""
    slim = stored(fingerprints(docs, width))
    found = classes(slim, radius)
    least = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = found.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(found.join(roots, "root").select("fp", "copies", "component_id"))
    return with_class(slim, named, ["component_id"]).select("doc_id", "text_hash", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, columns as they are: the row of the smallest id, of those the one of the smallest text
    hash; a row without an id stays only where no near-duplicate has one. Ids needn't be unique: rows of one id whose texts are no
    near-duplicates are classes of their own and all stay. Of rows repeated with id and text one stays."""
    slim = stored(fingerprints(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    each = slim.groupBy("fp").agg(first, F.count("*").alias("copies"))
    kept = classes(slim, radius).select("fp", "root").join(each, "fp").groupBy("root").agg(F.min("first").alias("first"))
    counts = slim.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n"))
    named = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    mine = same(F.col("_id"), F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    named = stored(named.join(counts, mine).select("_id", "_hash", "_n"))
    # what goes is the smaller part as a rule, so that its join seldom moves texts
    gone = stored(counts.join(named.where("_n = 1").drop("_n"), mine, "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    doc_id, text_hash = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    match = same(doc_id, F.col("_id")) & (text_hash == F.col("_hash"))
    single = docs.join(gone, match, "left_anti")
    again = named.where("_n > 1").select("_id", "_hash")
    if again.isEmpty():
        return single
    repeated = docs.join(again, match).dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")
    return single.unionByName(repeated)

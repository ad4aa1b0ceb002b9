"""Hard negatives by segment summary filtering.

A vector is cut into segments, in levels: one segment, then 4, then 16 (fewer where it has fewer components). Every segment's mean and deviation is stored.
For two vectors the products of the segments' means, times their lengths, add up to an estimate of the inner product that is wrong by
at most the sum of the products of their deviations, times their lengths (Cauchy and Schwarz on what differs from the mean). So a level bounds a
score from below and above with a few products instead of one per component. Pairs that the bounds rule out go; the
rest is looked at again with the next level's finer segments, and only what is left is scored exactly, in whole numbers.

Rows lie in shards of bounded size in order of (length, label, hash), so a label fills as many neighbouring shards as it needs and a hot
label is spread. Anchors are the stated query set, and meet shards as a stream: a task loads one shard, then takes one batch of anchors after the
other. For positives an anchor visits the shards with its label, and a pair goes when its upper bound is below the anchor's best found so far;
for negatives it visits the shards with other labels, and a pair goes when its bounds lie outside of all the anchor's score bands or below what a band
already has. The best of each shard are merged by a window of a few rows per anchor and shard. Results are exact: no candidate is left
out but by a bound.

Odd rows: a null id, label or vector, or a null or non-finite component, takes no part, and neither does a vector so long that scores leave the range of
a long (scaled length of 2^31 or more). Of rows with one id the least (label, vector) counts. Vectors of different lengths never meet; empty vectors
score 0 with each other. Other columns are left out whatever their names. Fewer positives or negatives than asked for give fewer rows;
an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import ready, stored

SCALE = 256
FINEST, MERGE = 16, 4  # segments of the last level; segments of a level that make one of the level before
SHARD_VALUES, SHARD_LEAST = 1 << 22, 1024  # components of a shard at most; rows that are worth a shard of their own
ANCHORS, CANDIDATES = 256, 4096  # pairs looked at together
LOWEST = np.iinfo(np.int64).min
ROWS = "vec_id long, label long, dim int, vector array<double>, means array<float>, devs array<float>"


def quantised(rows: DataFrame, vec: str = "embedding", label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, dim, vector`` of the rows that take part, components as whole numbers ``floor(scale * x)``; one row per id."""
    x = F.transform(F.col(vec), lambda c: c.cast("double") * scale)
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**31)) & (F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c) < 2.0**62)
    slim = slim.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    whole = slim.select("vec_id", "label", F.transform("x", lambda c: F.floor(c).cast("double")).alias("vector"))
    least = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return least.select("vec_id", F.col("r.label").alias("label"), F.size("r.vector").alias("dim"), F.col("r.vector").alias("vector"))


def relabelled(rows: DataFrame) -> DataFrame:
    """``quantised`` rows of which every seventh id has the next label of ten, as wrong labels to mine against."""
    label = F.col("label").cast("long")
    return quantised(rows, label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


# ---------------------------------------------------------------- summaries
def segment_starts(dim: int) -> list[np.ndarray]:
    """The first components of the segments, per level; levels nest."""
    if not dim:
        return []
    n = min(FINEST, dim)
    levels = [np.arange(n) * dim // n]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0][::MERGE])
    return levels


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments of all levels, a row per row of ``x``."""
    means, devs = [np.zeros((len(x), 0))], [np.zeros((len(x), 0))]
    for starts in segment_starts(x.shape[1]):
        length = np.diff(np.append(starts, x.shape[1]))
        mean = np.add.reduceat(x, starts, axis=1) / length
        rest = x - np.repeat(mean, length, axis=1)
        means.append(mean)
        devs.append(np.sqrt(np.add.reduceat(rest * rest, starts, axis=1) / length))
    return np.concatenate(means, 1), np.concatenate(devs, 1)


class Side:
    """Vectors of one length with their summaries, scaled so that products of two sides' rows are estimates and radii."""

    def __init__(self, ids, labels, x, means, devs):
        self.ids, self.labels, self.x = ids, labels, x
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0)))
        self.levels, at = [], 0
        for starts in segment_starts(x.shape[1]):
            root = np.sqrt(np.diff(np.append(starts, x.shape[1])))
            part = slice(at, at := at + len(starts))
            self.levels.append((means[:, part] * root, devs[:, part] * root))

    def part(self, rows) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.x, out.norm, out.levels = self.ids[rows], self.labels[rows], self.x[rows], self.norm, [(m[rows], d[rows]) for m, d in self.levels]
        return out


def survivors(a: Side, c: Side, alive: np.ndarray, possible) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns with a pair of ``alive`` that the bounds of no level rule out; ``alive`` is narrowed to those pairs.
    ``possible(rows, low, high)`` says which pairs may matter."""
    slack = 1e-6 * a.norm * c.norm + 1e-6  # summaries are stored in single precision
    for (am, ad), (cm, cd) in zip(a.levels, c.levels):
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            break
        middle, radius = am[rows] @ cm[cols].T, ad[rows] @ cd[cols].T + slack
        at = np.ix_(rows, cols)
        alive[at] &= possible(rows, middle - radius, middle + radius)
    return np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))


def exact_scores(a: Side, c: Side, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers. Below 2^52 sums of doubles are exact; above, those of integers are."""
    if a.norm * c.norm < 2.0**52:
        return (a.x[rows] @ c.x[cols].T).astype(np.int64)
    return a.x[rows].astype(np.int64) @ c.x[cols].astype(np.int64).T


class Best:
    """The ``k`` best (score, then smaller id) of each row so far."""

    def __init__(self, rows: int, k: int):
        self.k, self.least = k, np.full(rows, LOWEST)
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray) -> None:
        take = valid & (scores >= self.least[rows][:, None])
        if scores.shape[1] > self.k and take.sum() > 8 * self.k * len(rows):
            bar = np.partition(np.where(take, scores, LOWEST), -self.k, axis=1)[:, -self.k]
            take &= scores >= bar[:, None]
        i, j = np.nonzero(take)
        if not len(i):
            return
        row, score, own = np.append(self.row, rows[i]), np.append(self.score, scores[i, j]), np.append(self.id, ids[j])
        order = np.lexsort((own, -score, row))
        row, score, own = row[order], score[order], own[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        full = place == self.k - 1
        self.least[row[full]] = score[full]
        self.row, self.score, self.id = row[keep], score[keep], own[keep]


def nearest_alike(a: Side, c: Side, k: int) -> Best:
    """The ``k`` best of ``c`` with an anchor's label, for each anchor of ``a``."""
    best = Best(len(a.ids), k)
    for at in range(0, len(c.ids), CANDIDATES):
        part = c.part(slice(at, at + CANDIDATES))
        alive = (a.labels[:, None] == part.labels) & (a.ids[:, None] != part.ids)
        rows, cols = survivors(a, part, alive, lambda r, low, high: high >= best.least[r][:, None])
        if len(rows):
            best.add(rows, part.ids[cols], exact_scores(a, part, rows, cols), alive[np.ix_(rows, cols)])
    return best


def nearest_in_bands(a: Side, c: Side, low: np.ndarray, high: np.ndarray, k: int) -> list[Best]:
    """For each band ``low[:, j] .. high[:, j]`` of an anchor's scores, the ``k`` best of ``c`` in it that have another label."""
    best = [Best(len(a.ids), k) for _ in range(low.shape[1])]

    def possible(r, lower, upper):
        out = np.zeros(lower.shape, bool)
        for j, b in enumerate(best):
            out |= (lower <= high[r, j][:, None]) & (upper >= np.maximum(low[r, j], b.least[r])[:, None])
        return out

    for at in range(0, len(c.ids), CANDIDATES):
        part = c.part(slice(at, at + CANDIDATES))
        alive = a.labels[:, None] != part.labels
        rows, cols = survivors(a, part, alive, possible)
        if len(rows):
            scores, mine = exact_scores(a, part, rows, cols), alive[np.ix_(rows, cols)]
            for j, b in enumerate(best):
                b.add(rows, part.ids[cols], scores, mine & (scores >= low[rows, j][:, None]) & (scores <= high[rows, j][:, None]))
    return best


def percent(p: np.ndarray, share: int, up: bool) -> np.ndarray:
    """``share * p / 100`` rounded down or up, without a product that could leave 64 bits."""
    whole, rest = p // 100, p % 100 * share
    return whole * share + (-(-rest // 100) if up else rest // 100)


# ---------------------------------------------------------------- the index and its visitors
def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
            means, devs = summaries(_matrix(rows.column("vector"), len(rows)))
            lists = [pa.array(list(m.astype(np.float32)), pa.list_(pa.float32())) for m in (means, devs)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("vec_id", "label", "dim", "vector")), *lists], ["vec_id", "label", "dim", "vector", "means", "devs"])


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """``ROWS`` and their shard, of ``quantised`` rows, and the number of shards: as many as the session has cores, if they get
    ``SHARD_LEAST`` rows each, and more where a shard would have over ``SHARD_VALUES`` components."""
    spark = ready(rows.sparkSession)
    summed = stored(rows.mapInArrow(_summarise, ROWS))
    size = summed.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    per_shard = max(1, min(SHARD_VALUES // max(1, size["dim"] or 1), max(SHARD_LEAST, -(-size["n"] // spark.sparkContext.defaultParallelism))))
    placed = number_rows(summed.withColumn("_all", F.lit(0)).withColumn("_hash", F.xxhash64("vec_id")), "_all", ["dim", "label", "_hash"], out="_place")
    return placed.withColumn("shard", F.floor(F.col("_place") / per_shard).cast("int")).drop("_all", "_hash", "_place"), max(1, -(-size["n"] // per_shard))


def _sides(rows: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, Side]]:
    """Per length of vectors, the places of the rows and their side."""
    dims, out = rows.column("dim").to_numpy(), {}
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        own = rows.take(pa.array(at))
        own = own.combine_chunks().to_batches()[0] if isinstance(own, pa.Table) else own
        out[int(dim)] = at, Side(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), *(_matrix(own.column(c), len(own)) for c in ("vector", "means", "devs")))
    return out


def _visit(work):
    """Rows come in order of (shard, anchor or not): a shard's own rows are kept until the next shard's, anchors meet them in batches.
    ``work(anchors, places, candidates, batch)`` yields result batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept, loaded = None, [], None
        for batch in batches:
            shards, anchor = batch.column("shard").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (anchor[1:] != anchor[:-1])) + 1
            for first, last in zip([0, *cuts], [*cuts, len(batch)]):
                if first == last:
                    continue
                rows = batch.slice(first, last - first)
                if shards[first] != shard:
                    shard, kept, loaded = shards[first], [], None
                if not anchor[first]:
                    kept.append(rows)
                    continue
                if loaded is None:
                    loaded, kept = _sides(pa.Table.from_batches(kept)) if kept else {}, []
                for at in range(0, len(rows), ANCHORS):
                    asked = rows.slice(at, ANCHORS)
                    for dim, (places, side) in _sides(asked).items():
                        if dim in loaded:
                            yield from work(side, places, loaded[dim][1], asked)

    return run


def _alike(k: int):
    def work(a: Side, places, c: Side, batch) -> Iterator[pa.RecordBatch]:
        best = nearest_alike(a, c, k)
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[best.row]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "vec_id", "score"])

    return _visit(work)


def _bands(k: int, low: int, high: int):
    def work(a: Side, places, c: Side, batch) -> Iterator[pa.RecordBatch]:
        lists = [batch.column("positives")[int(i)].as_py() for i in places]
        width = max(map(len, lists))
        ids, score = np.zeros((len(lists), width), np.int64), np.zeros((len(lists), width), np.int64)
        lowest, highest = np.ones((len(lists), width), np.int64), np.zeros((len(lists), width), np.int64)  # an empty band
        for i, own in enumerate(lists):
            for j, p in enumerate(own):
                ids[i, j], score[i, j] = p["vec_id"], p["score"]
            lowest[i, : len(own)], highest[i, : len(own)] = percent(score[i, : len(own)], low, True), percent(score[i, : len(own)], high, False)
        for j, best in enumerate(nearest_in_bands(a, c, lowest, highest, k)):
            columns = [a.ids[best.row], ids[best.row, j], score[best.row, j], best.id, best.score]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return _visit(work)


def _visits(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Each shard's rows, then its anchors."""
    extra = [f for f in anchors.schema.fields if f.name not in rows.columns]
    own = rows.select("*", F.lit(False).alias("anchor"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    both = own.unionByName(anchors.withColumn("anchor", F.lit(True)))
    return both.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "anchor")


def positives(rows: DataFrame, shards: int, every: int, k: int) -> DataFrame:
    """``vec_id, positives``: of each anchor its ``k`` best other rows with the same label, ``(score, vec_id)``, best first."""
    where = rows.groupBy("dim", "label").agg(F.min("shard").alias("_from"), F.max("shard").alias("_to"))
    anchors = rows.where(F.col("vec_id") % every == 0).drop("shard").join(where, ["dim", "label"])
    sent = anchors.select(*[c for c in rows.columns if c != "shard"], F.explode(F.sequence("_from", "_to")).alias("shard"))
    found = _visits(rows, sent, shards).mapInArrow(_alike(k), "anchor_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("_place", place).where(F.col("_place") <= k)
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("_place", "score", "vec_id"))).alias("p"))
    return lists.select(F.col("anchor_id").alias("vec_id"), F.transform("p", lambda p: F.struct(p["score"].alias("score"), p["vec_id"].alias("vec_id"))).alias("positives"))


def hard_negatives(rows: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``quantised`` rows. Anchors are the ids divisible by ``every``; for each of
    their ``n_positives`` best rows of the same label, the ``n_negatives`` best of other labels whose score is between ``low`` and ``high`` per cent of the
    positive's."""
    placed, shards = index(rows)
    found = stored(positives(placed, shards, every, n_positives))
    spans = placed.groupBy("dim").agg(F.min("shard").alias("_least"), F.max("shard").alias("_most"))
    labels = placed.groupBy("dim", "label").agg(F.min("shard").alias("_from"), F.max("shard").alias("_to"))
    anchors = placed.where(F.col("vec_id") % every == 0).drop("shard").join(found, "vec_id").join(labels.join(spans, "dim"), ["dim", "label"])
    # shards between the first and the last of the anchor's label hold that label only
    visited = F.filter(F.sequence("_least", "_most"), lambda s: (s <= F.col("_from")) | (s >= F.col("_to")))
    sent = anchors.select(*[c for c in placed.columns if c != "shard"], "positives", F.explode(visited).alias("shard"))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    each = _visits(placed, sent, shards).mapInArrow(_bands(n_negatives, low, high), schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    best = each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n_negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

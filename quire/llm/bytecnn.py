"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by chunks of ``CHUNK`` bytes that overlap by half; the last one is
filled up with an empty symbol. Filters of ``WIDTH`` bytes slide over every byte of the document, the
largest response of a filter in a chunk is kept, and the mean and the maximum over the chunks go through one
logistic unit. So each byte counts, however long the text is. A filter's weight for a byte is a
table entry, which makes the convolution of one-hot bytes a sum of ``WIDTH`` look-ups.

Filters and unit are trained together by gradient steps on a bounded sample of labelled rows: the
first ``FIT_ROWS`` by the hash of the id, with texts up to ``FIT_BYTES`` bytes. Rows held out (a fifth, by
CRC-32 of the id) are never learned. The sample is fixed by the table, so reruns agree.

A null text is an empty one, and an empty one is a chunk of empty symbols: its score is that of
the bias. Without labels the score is 0.5 for all rows, with one label its share. Repeated rows are
scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ready

FILTERS, WIDTH, CHUNK = 32, 5, 1024
EMPTY = 256
FIT_ROWS, FIT_BYTES, EPOCHS, BATCH = 2000, 20_000, 25, 64
SLICE_BYTES = 1 << 20


@dataclass
class Network:
    filters: np.ndarray  # WIDTH, 257 symbols, FILTERS
    bias: np.ndarray
    unit: np.ndarray  # weights of the means, then of the maxima
    offset: float


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, each filled up to whole half chunks (by WIDTH - 1 symbols at least), and the half chunks of each."""
    half = CHUNK // 2
    n = np.array([len(t) for t in texts], np.int64)
    halves = np.maximum(1, -(-(n + WIDTH - 1) // half))
    out = np.full(int(halves.sum()) * half, EMPTY, np.int16)
    starts = (np.cumsum(halves) - halves) * half
    for t, at in zip(texts, starts.tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return out, halves


def responses(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Each filter's response to the symbols that end at each place. A text is followed by WIDTH - 1 empty symbols
    at least, so none sees two texts."""
    wide = np.concatenate((np.full(WIDTH - 1, EMPTY, x.dtype), x))
    out = np.take(filters[0], wide[: len(x)], axis=0)
    part = np.empty_like(out)
    for j in range(1, WIDTH):
        np.take(filters[j], wide[j : j + len(x)], axis=0, out=part)
        out += part
    return out


def half_maxima(x: np.ndarray, filters: np.ndarray, where: bool = False):
    half, best, place = CHUNK // 2, [], []
    for at in range(0, len(x), half * 64):  # a piece that fits the cache, with the symbols before it
        stop, before = min(len(x), at + half * 64), min(at, WIDTH - 1)
        r = responses(x[at - before : stop], filters)[before:].reshape(-1, half, filters.shape[2])
        if where:
            k = r.argmax(1)
            place.append(k + (at + np.arange(len(k)) * half)[:, None])
            best.append(np.take_along_axis(r, k[:, None, :], 1)[:, 0])
        else:
            best.append(r.max(1))
    return np.concatenate(best), np.concatenate(place) if where else None


def chunks_of(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last half of each chunk, and the chunks of each text."""
    n = np.maximum(1, halves - 1)
    starts = np.repeat(np.cumsum(halves) - halves, n)
    first = starts + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first, first + (np.repeat(halves, n) > 1), n


def scores(texts: list[bytes], net: Network) -> np.ndarray:
    """Probability of label 1 of each text."""
    if not texts:
        return np.zeros(0)
    x, halves = symbols(texts)
    best, _ = half_maxima(x, net.filters)
    first, last, n = chunks_of(halves)
    active = np.maximum(np.maximum(best[first], best[last]) + net.bias, 0)
    starts = np.cumsum(n) - n
    features = np.concatenate((np.add.reduceat(active, starts, axis=0) / n[:, None], np.maximum.reduceat(active, starts, axis=0)), 1)
    return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ net.unit + net.offset, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the log loss of small batches."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, EMPTY + 1, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    net.filters[:, EMPTY] = 0
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        net.unit[:] = 0
        net.offset = float(np.log((share + 1e-6) / (1 - share + 1e-6))) if len(labels) else 0.0
        return net
    net.offset = float(np.log(share / (1 - share)))
    names = ("filters", "bias", "unit", "offset")
    first_moment, second_moment = ({k: np.zeros_like(np.asarray(getattr(net, k), np.float64)) for k in names} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows, step = order[at : at + BATCH], step + 1
            x, halves = symbols([texts[i] for i in rows])
            best, place = half_maxima(x, net.filters, where=True)
            a, b, n = chunks_of(halves)
            later = best[b] > best[a]
            at_place = np.where(later, place[b], place[a])
            before = np.where(later, best[b], best[a]) + net.bias
            active, starts = np.maximum(before, 0), np.cumsum(n) - n
            highest = np.maximum.reduceat(active, starts, axis=0)
            features = np.concatenate((np.add.reduceat(active, starts, axis=0) / n[:, None], highest), 1).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(features @ net.unit + net.offset, -30, 30)))
            error = (p - labels[rows]) / len(rows)
            owner = np.repeat(np.arange(len(rows)), n)
            top = active == highest[owner]
            down = error[owner, None] * (net.unit[:FILTERS] / n[owner, None] + net.unit[FILTERS:] * top) * (before > 0)
            wide = np.concatenate((np.full(WIDTH - 1, EMPTY, x.dtype), x))
            grad = np.zeros(net.filters.shape)
            for j in range(WIDTH):
                np.add.at(grad[j], (wide[at_place + j], np.arange(FILTERS)[None, :]), down)
            grad[:, EMPTY] = 0
            gradients = {"filters": grad + 1e-4 * net.filters, "bias": down.sum(0), "unit": features.T @ error + 1e-3 * net.unit, "offset": error.sum()}
            rate = 0.02 * (1 - epoch / epochs)
            for k, g in gradients.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                move = rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                value = getattr(net, k) - move
                setattr(net, k, float(value) if k == "offset" else value.astype(np.float32) if k != "unit" else value)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> Network:
    """A network from the labelled rows that are not held out. At most ``rows`` texts of ``max_bytes`` come to the driver."""
    ready(docs.sparkSession)
    order = F.xxhash64("doc_id")
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = picked.dropna().groupBy("doc_id").agg(F.min("_label").alias("_label")).orderBy(order, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    sample = texts.join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id", F.xxhash64("text")).limit(rows).collect()
    return train([r["text"].encode() for r in sample], np.array([r["_label"] for r in sample], float))


def _scored(column: pa.Array, net: Network) -> np.ndarray:
    """Scores of a column of texts, a few MB at a time."""
    raw = column.fill_null("").cast(pa.binary())
    ends = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(raw):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        out.append(scores(raw.slice(at, stop - at).to_numpy(zero_copy_only=False).tolist(), net))
        at = stop
    return np.concatenate(out) if out else np.zeros(0)


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` of every row of ``docs(doc_id, text)``."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scored(batch.column("text"), net))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Network, least: float = 0.3) -> DataFrame:
    """``docs`` with all its columns, without the rows that score below ``least``."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column("text"), net) >= least))

    return docs.mapInArrow(run, docs.schema)

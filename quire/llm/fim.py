"""Fill-in-middle transformation with a learned index from code-point ranks to byte offsets.

A text arrives as UTF-8 bytes, and its cuts are ranks of code points. The boundary offsets of all code points (the byte at which each begins,
and the end) form a rising curve over the ranks. ``RankIndex`` covers it with straight pieces whose error is at most ``ERROR``
bytes: a piece starts at a boundary, a cone of slopes is narrowed by every boundary that follows (with running maxima and
minima over growing windows), and where the cone closes the next piece begins. What a piece
predicts and what is true differ by a stored residual of one byte per boundary, so a lookup finds its piece, predicts, adds the residual, and is
exact. The curve is fitted in blocks of ``BLOCK`` boundaries, so that a long text needs little more memory than itself.

Hashes of ``1:`` and the document's id give the two cuts and the form. ``plain`` leaves the text as it is: an empty one, one that has a sentinel in
it, and a tenth of all others; ``psm`` is prefix, suffix, middle, each after its sentinel; ``spm`` is suffix, prefix, middle.
As no other text has a sentinel, ``restored`` rebuilds it from output and form alone.

Odd rows: a null text is an empty one, a null id hashes as an empty one, repeated rows and ids are transformed one by one, other columns
are left out whatever their names, an empty table gives none. A task holds one text, its index and a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
ERROR = 120  # bytes; a residual, with its rounding, fits eight bits
BLOCK = 1 << 18
_WINDOW = 256
_BATCH = 4 << 20


def boundary_offsets(data: np.ndarray) -> np.ndarray:
    """Where the code points of UTF-8 ``data`` (uint8) begin."""
    return np.flatnonzero((data & 0xC0) != 0x80)


class RankIndex:
    """Offsets of ranks 0 .. n, n the end: pieces ``(first rank, first offset, slope)`` and a residual per rank."""

    def __init__(self, ranks: np.ndarray, offsets: np.ndarray, slopes: np.ndarray, residuals: np.ndarray):
        self.ranks, self.offsets, self.slopes, self.residuals = ranks, offsets, slopes, residuals

    @classmethod
    def of(cls, data: np.ndarray, error: int = ERROR, block: int = BLOCK) -> RankIndex:
        ranks, offsets, slopes, residuals, done = [], [], [], [], 0
        for at in range(0, len(data), block):
            part = boundary_offsets(data[at : at + block]) + at
            if at + block >= len(data):
                part = np.append(part, len(data))
            if not len(part):
                continue
            for first, last, slope in pieces(part, error):
                ranks.append(done + first)
                offsets.append(int(part[first]))
                slopes.append(slope)
                residuals.append((part[first:last] - predicted(part[first], slope, np.arange(last - first))).astype(np.int8))
            done += len(part)
        if not len(data):
            ranks, offsets, slopes, residuals = [0], [0], [1.0], [np.zeros(1, np.int8)]
        return cls(np.array(ranks, np.int64), np.array(offsets, np.int64), np.array(slopes), np.concatenate(residuals))

    def __len__(self) -> int:
        return len(self.residuals) - 1

    def lookup(self, ranks) -> np.ndarray:
        """The exact byte offsets of ``ranks``."""
        ranks = np.asarray(ranks, np.int64)
        piece = np.searchsorted(self.ranks, ranks, "right") - 1
        return predicted(self.offsets[piece], self.slopes[piece], ranks - self.ranks[piece]) + self.residuals[ranks]


def predicted(offset, slope, steps) -> np.ndarray:
    return offset + np.rint(slope * steps).astype(np.int64)


def pieces(offsets: np.ndarray, error: int) -> Iterator[tuple[int, int, float]]:
    """``(first, last, slope)`` of pieces ``offsets[first:last]`` that a line through their first point meets within ``error``."""
    n, start = len(offsets), 0
    while start < n:
        low, high, at, size, end = -np.inf, np.inf, start + 1, _WINDOW, n
        while at < n:
            stop = min(n, at + size)
            step = np.arange(at - start, stop - start, dtype=np.float64)
            rise = offsets[at:stop] - offsets[start]
            lows = np.maximum(np.maximum.accumulate((rise - error) / step), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / step), high)
            closed = lows > highs
            if closed.any():
                k = int(closed.argmax())
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end = at + k
                break
            low, high, at, size = lows[-1], highs[-1], stop, size * 2
        yield start, end, float((low + high) / 2) if end > start + 1 else 1.0
        start = end


def assembled(data: bytes, form: str, cuts: np.ndarray) -> bytes:
    if form == "plain":
        return data
    a, b = int(cuts[0]), int(cuts[1])
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, n, form, first, second``: the text's code points, its form and the ranks of its cuts."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256)
    rows = rows.select("*", F.char_length("_text").cast("long").alias("n"), *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)])
    whole = (F.col("n") == 0) | (F.col("_h3") % 100 >= PLAIN_FROM)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        whole = whole | F.col("_text").contains(sentinel)
    form = F.when(whole, "plain").when(F.col("_h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    return rows.select(F.col("_key").alias(key), F.col("_text").alias("text"), "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


_INDEX = "segments array<struct<rank: long, offset: long, slope: double>>, residuals binary"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_index: bool = False) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row of ``docs(key, text)``; lengths are null where the form is plain.
    ``keep_index``: also every text's index, ``segments`` and ``residuals``, from which any other cut can be looked up."""
    ready(docs.sparkSession)
    plan = planned(docs, key, text)
    schema = f"key {plan.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary" + (f", {_INDEX}" if keep_index else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, indexes, size, since = [], [], 0, 0
            values = batch.column("text").cast(pa.binary()) if pa.types.is_string(batch.column("text").type) else batch.column("text")
            forms, firsts, seconds = (batch.column(c).to_pylist() for c in ("form", "first", "second"))

            def flush(upto: int) -> pa.RecordBatch:
                rows = batch.slice(since, upto - since)
                plain = np.array([f == "plain" for f in forms[since:upto]])
                a, b = (rows.column(c).to_numpy() for c in ("first", "second"))
                columns = [rows.column(key), rows.column("n"), rows.column("form"), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(made, pa.binary())]
                names = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]
                if keep_index:
                    parts = [[{"rank": r, "offset": o, "slope": s} for r, o, s in zip(x.ranks.tolist(), x.offsets.tolist(), x.slopes.tolist())] for x in indexes]
                    columns += [pa.array(parts, pa.list_(pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())]))), pa.array([x.residuals.tobytes() for x in indexes], pa.binary())]
                    names += ["segments", "residuals"]
                return pa.RecordBatch.from_arrays(columns, names)

            for i, form in enumerate(forms):
                data = values[i].as_py()
                cuts = None
                if keep_index or form != "plain":
                    index = RankIndex.of(np.frombuffer(data, np.uint8))
                    cuts = index.lookup([firsts[i], seconds[i]])
                    if keep_index:
                        indexes.append(index)
                made.append(assembled(data, form, cuts))
                size += len(made[-1])
                if size > _BATCH:
                    yield flush(i + 1)
                    made, indexes, size, since = [], [], 0, i + 1
            if made:
                yield flush(len(forms))

    found = plan.mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"), *(["segments", "residuals"] if keep_index else []))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)

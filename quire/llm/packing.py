"""Harmonic packing of documents' token ids into sequences of one capacity.

A document of n ids that fits a sequence belongs to class k = capacity / n, rounded down: the lengths over capacity / (k + 1) and up to capacity / k. A bin
of class k takes exactly k documents, whole, and is then full whatever their lengths; ``CLASSES`` is the last class, for all shorter ones. What
a full bin leaves free is less than its class's lengths can use, and is filled with cuts of the stuffing: documents longer than a sequence, which
must be cut anyway. Where a worker has too little of those, full bins wait, and when ``WAITING`` of them do, the one with the most room
becomes stuffing for the others; where it has too much, the stuffing fills sequences of its own. So nearly all documents that fit stay whole, and a
finished sequence has no padding.

Each worker (task) packs the documents of its own partition and needs nothing from the others. At its end the documents of open bins go where they fit
whole, bins with the most room become stuffing for the rest, and what the last sequence holds is cut into sequences whose lengths are powers of two, which need no
padding either. So no id is padded whatever the number of workers.

A null text is empty: the end id alone. Empty tables give no pieces; repeated rows are packed
as often as they occur; any number of ids per document works. Memory: the ids of one slice of
texts, of ``WAITING`` bins and as much stuffing, and of one open bin per class. ``sequence_id`` is the task's number (upper bits) and a
counter, so a rerun of a lost task gives the same rows.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ready
from .tokens import encoder, slices, vocabulary, with_end

CLASSES = 32
WAITING = 512  # full bins with room, and sequences' worth of stuffing, that a worker keeps
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW_PIECE = pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])


def class_of(length: int, capacity: int, classes: int = CLASSES) -> int:
    """How many documents a bin of this length's class takes."""
    return min(classes, capacity // length)


class Packer:
    """Bins of one worker. ``add`` and ``flush`` finish pieces: (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, first_sequence: int = 0, classes: int = CLASSES, waiting: int = WAITING):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError(f"the capacity must be a power of two, not {capacity}")
        self.capacity, self.sequence, self.classes, self.most = capacity, first_sequence, classes, waiting
        self.open: dict[int, list] = {}
        self.waiting: list[list] = []  # heap of (-room, number, pieces)
        self.stuffing: deque = deque()
        self.stuffed = self.number = 0
        self.done: list = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def _cut(self, length: int) -> list:
        """The next ``length`` ids of the stuffing, or all there are."""
        out = []
        while length and self.stuffing:
            doc, start, ids, total = self.stuffing.popleft()
            n = min(length, len(ids) // 4)
            out.append((doc, start, ids[: n * 4], total))
            if n * 4 < len(ids):
                self.stuffing.appendleft((doc, start + n, ids[n * 4 :], total))
            length -= n
            self.stuffed -= n
        return out

    def _stuff(self, pieces: list) -> None:
        self.stuffing.extend(pieces)
        self.stuffed += sum(len(p[2]) // 4 for p in pieces)

    def _wait(self, pieces: list) -> None:
        room = self.capacity - sum(len(p[2]) // 4 for p in pieces)
        if not room:
            self._close(pieces)
            return
        self.number += 1
        heapq.heappush(self.waiting, (-room, self.number, pieces))

    def _settle(self, most: int) -> None:
        """Fill waiting bins while there is stuffing, and keep at most ``most`` of them and as much stuffing."""
        while self.waiting:
            room = -self.waiting[0][0]
            if self.stuffed >= room:
                self._close([*heapq.heappop(self.waiting)[2], *self._cut(room)])
            elif len(self.waiting) > max(1, most):
                self._stuff(heapq.heappop(self.waiting)[2])
            else:
                break
        while self.stuffed >= max(1, most) * self.capacity:
            self._close(self._cut(self.capacity))

    def add(self, doc: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        total = len(ids) // 4
        piece = (doc, 0, ids, total)
        if total > self.capacity:
            self._stuff([piece])
        else:
            k = class_of(total, self.capacity, self.classes)
            own = self.open.setdefault(k, [])
            own.append(piece)
            if len(own) < k:
                return
            self.open[k] = []
            self._wait(own)
        self._settle(self.most)

    def flush(self) -> None:
        """End the open bins, and what is left as sequences whose lengths are powers of two."""
        left = sorted((p for own in self.open.values() for p in own), key=lambda p: -len(p[2]))
        self.open = {}
        for piece in left:  # into the fullest bin that has room for it
            length = len(piece[2]) // 4
            fits = [b for b in self.waiting if -b[0] >= length]
            best = min(fits, key=lambda b: -b[0]) if fits else None
            if best is not None:
                self.waiting.remove(best)
            self._wait([*(best[2] if best else ()), piece])
        heapq.heapify(self.waiting)
        self._settle(0)
        while self.waiting:
            self._stuff(heapq.heappop(self.waiting)[2])
        while self.stuffed:
            self._close(self._cut(min(self.capacity, 1 << (self.stuffed.bit_length() - 1))))

    def take(self) -> list:
        out, self.done = self.done, []
        return out


def _rows(pieces: list) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_PIECE, strict=True)], schema=ARROW_PIECE)


def _pack(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(path), Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch):
                ids, n = with_end(*words.encode(part.column("text")), end)
                raw, stop = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
                for doc, a, b in zip(part.column("doc_id").to_pylist(), [0, *stop[:-1]], stop, strict=True):
                    packer.add(doc, raw[a:b])
                if done := packer.take():
                    yield _rows(done)
        packer.flush()
        if done := packer.take():
            yield _rows(done)

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their ids and places: ``doc_id, start, length, ids,
    doc_tokens, sequence_id, offset``. No shuffle: every task packs its own partition."""
    ready(docs.sparkSession)
    Packer(capacity)  # refuses a wrong capacity here rather than in a task
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(_pack(tokenizer or vocabulary(), end, capacity), PIECE_SCHEMA)

"""R2 online boundary detection with ``transformWithStateInPandas``.

Per input the state is O(vector size): the running sum of the current segment, its label and
the next page number expected. Pages ahead of their turn wait in a map state keyed by
page number; those whose turn comes within the batch never touch it. Results
equal the batch fold (W1) whatever the arrival order. A page whose turn has passed is reported
with ``status = 'late'`` instead of being silently dropped.

With an event time, an input closes when the stream's events are ``close_after_seconds`` past its last page: pages that still
wait for a lost one are put out with ``status = 'rejected'``, and what comes later is ``late`` (unless its own event time
is that old; Spark drops such rows before they get here).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..constants import DEFAULT_BOUNDARY_THRESHOLD

OUTPUT_SCHEMA = "input_id string, page_no int, label int, status string"

# The stateful processor is unpickled in a Python runner that does not get ``addPyFile``
# includes; ship this module's code by value so that runner never has to import ``quire``.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: fall back to import by name
    pass
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OnlineBoundaries(StatefulProcessor):
    def __init__(self, threshold: float | None = None, timed: bool = False):
        self.cut = 1.0 - (DEFAULT_BOUNDARY_THRESHOLD if threshold is None else float(threshold))
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seg = handle.getValueState("seg", "s array<double>, label int, next_page int, waiting int, closes long")
        self.ahead = handle.getMapState("ahead", "page_no int", "v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, label, nxt, waiting, closes = None, -1, 0, 0, 0
        if self.seg.exists():
            s_list, label, nxt, waiting, closes = self.seg.get()
            s = np.asarray(s_list, dtype=np.float64) if s_list else None
        out: list[tuple[int, int, str]] = []
        now: dict[int, list] = {}
        latest = 0
        for pdf in rows:
            for page, vec in zip(pdf["page_no"].tolist(), pdf["embedding"].tolist()):
                if page < nxt or closes < 0:
                    out.append((int(page), -1, "late"))
                else:
                    now[int(page)] = vec
            if self.timed:
                latest = max(latest, int(pdf["event_time"].max().timestamp() * 1000))
        while True:
            if nxt in now:
                v = np.asarray(now.pop(nxt), dtype=np.float64)
            elif waiting and self.ahead.containsKey((nxt,)):
                v = np.asarray(self.ahead.getValue((nxt,))[0], dtype=np.float64)
                self.ahead.removeKey((nxt,))
                waiting -= 1
            else:
                break
            if s is None:
                s, label = v.copy(), 0
            else:
                ns, nv = np.linalg.norm(s), np.linalg.norm(v)
                sim = 0.0 if ns == 0 or nv == 0 else float(np.dot(v, s) / (ns * nv))
                if sim < self.cut:
                    label += 1
                    s = v.copy()
                else:
                    s = s + v
            out.append((nxt, label, "ok"))
            nxt += 1
        for page, vec in now.items():
            waiting += not (waiting and self.ahead.containsKey((page,)))
            self.ahead.updateValue((page,), (list(map(float, vec)),))
        if self.timed and closes >= 0 and latest > closes:
            if closes:
                self.handle.deleteTimer(closes)
            closes = latest  # the watermark stays behind by the time to wait
            self.handle.registerTimer(closes)
        self.seg.update(([] if s is None else s.tolist(), int(label), int(nxt), int(waiting), int(closes)))
        if out:
            yield _rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s_list, label, nxt, waiting, _ = self.seg.get()
        left = sorted(int(k[0]) for k, _ in self.ahead.iterator()) if waiting else []
        for page in left:
            self.ahead.removeKey((page,))
        self.seg.update((list(s_list), int(label), int(nxt), 0, -1))
        if left:
            yield _rows(key[0], [(page, -1, "rejected") for page in left])

    def close(self) -> None:
        pass


def _rows(input_id, out: list[tuple[int, int, str]]) -> pd.DataFrame:
    pages, labels, status = zip(*out)
    return pd.DataFrame({"input_id": input_id, "page_no": pages, "label": labels, "status": status})


def online_boundaries(stream: DataFrame, threshold: float | None = None, event_time: str | None = None, close_after_seconds: float = 600.0) -> DataFrame:
    """Streaming ``(input_id, page_no, label, status)`` from a stream of ``(input_id, page_no, embedding)`` rows, in
    append mode. ``event_time``: a timestamp column by which inputs close, ``close_after_seconds`` after their last page."""
    if event_time is None:
        grouped = stream.select("input_id", "page_no", "embedding").groupBy("input_id")
        return grouped.transformWithStateInPandas(OnlineBoundaries(threshold), OUTPUT_SCHEMA, "Append", "None")
    timed = stream.select("input_id", "page_no", "embedding", F.col(event_time).alias("event_time")).withWatermark("event_time", f"{close_after_seconds} seconds")
    processor = OnlineBoundaries(threshold, timed=True)
    return timed.groupBy("input_id").transformWithStateInPandas(processor, OUTPUT_SCHEMA, "Append", "EventTime")

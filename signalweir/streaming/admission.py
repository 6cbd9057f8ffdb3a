"""Sliding-window admission on a stream: a subject's admitted times are its state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalweir.operators.admission import MAX_PER_WINDOW, MIN_GAP_MS, WINDOW_MS, Gate


#: Outcomes that are handed on at once.
CHUNK = 10_000


class AdmissionProcessor(StatefulProcessor):
    def __init__(self, window_ms: int, max_per_window: int, min_gap_ms: int):
        self.limits = (window_ms, max_per_window, min_gap_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.admitted.get()] if self.admitted.exists() else []
        gate = Gate(*self.limits, held)
        # of a subject's rows only two numbers each are held
        times, ids = (np.concatenate(x) for x in zip(*[(f["ts_ms"].to_numpy(np.int64), f["request_id"].to_numpy(np.int64)) for f in rows]))
        order = np.lexsort((ids, times))
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            outcomes = [gate.ask(t) for t in times[part].tolist()]
            yield pd.DataFrame({"subject": key[0], "request_id": ids[part], "ts_ms": times[part], "outcome": outcomes})
        if gate.held:
            self.admitted.put([(t,) for t in gate.held])
        else:
            self.admitted.clear()

    def close(self) -> None:
        pass


def stream_admission(
    requests: DataFrame, window_ms: int = WINDOW_MS, max_per_window: int = MAX_PER_WINDOW, min_gap_ms: int = MIN_GAP_MS
) -> DataFrame:
    """Outcomes for a stream of subject, request_id, ts_ms."""
    kind = requests.schema["subject"].dataType.simpleString()
    return requests.groupBy("subject").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(window_ms, max_per_window, min_gap_ms),
        outputStructType=f"subject {kind}, request_id long, ts_ms long, outcome string",
        outputMode="append",
        timeMode="none",
    )

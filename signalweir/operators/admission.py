"""Sliding-window admission: ok, too-fast or rate-limited per request of a subject.

Only admitted requests use up the window.  Requests: subject, ts_ms, request_id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.scale import SLICE, OrderedSlices

WINDOW_MS = 60_000
MAX_PER_WINDOW = 15
MIN_GAP_MS = 1500


class Gate:
    """Admitted times of one subject inside the window."""

    def __init__(self, window: int, most: int, gap: int, held: list[int] | None = None):
        self.window, self.most, self.gap = window, most, gap
        self.held = deque(held or [])

    def ask(self, now: int) -> str:
        while self.held and now - self.held[0] > self.window:
            self.held.popleft()
        if self.held and now - self.held[-1] < self.gap:
            return "too-fast"
        if len(self.held) >= self.most:
            return "rate-limited"
        self.held.append(now)
        return "ok"


def admission_decisions(
    requests: DataFrame, window_ms: int = WINDOW_MS, max_per_window: int = MAX_PER_WINDOW, min_gap_ms: int = MIN_GAP_MS
) -> DataFrame:
    """Add `outcome` to each request.

    Requests are cut into slices of the order (subject, time, id), so a subject that never
    pauses spans as many slices as it needs.  Each slice runs the gate from an empty window
    and reports the window it ends with; a slice whose subject comes in with another window
    than it assumed runs again, until none does.  A window holds max_per_window times at most
    and only one subject goes on from a slice to the next, so what the driver carries is
    bounded by the number of slices; the last run gives the outcomes.
    """
    order = [F.col("ts_ms").asc(), F.col("request_id").asc()]
    rows = OrderedSlices(requests, ["subject"], order).df.sortWithinPartitions(SLICE, "subject", *order)

    def gates(coming: dict[int, list[int]], batch: pd.DataFrame, at: dict) -> list[str]:
        """Outcomes of a batch; `at` holds the slice, subjects and gate that the batches before left."""
        outcomes = []
        for number, subject, now in zip(batch[SLICE], batch["subject"], batch["ts_ms"]):
            if at.get("slice") != number:
                at.update(slice=number, first=subject, subject=subject, gate=Gate(window_ms, max_per_window, min_gap_ms, coming.get(number)))
            elif at["subject"] != subject:
                at.update(subject=subject, gate=Gate(window_ms, max_per_window, min_gap_ms))
            outcomes.append(at["gate"].ask(now))
        return outcomes

    def ends(coming: dict[int, list[int]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at: dict = {}
            for batch in batches:
                gates(coming, batch, at)
            if at:  # a partition is one slice
                yield pd.DataFrame({"slice": [at["slice"]], "first": [at["first"]], "last": [at["subject"]], "held": [list(at["gate"].held)]})

        return run

    kind = requests.schema["subject"].dataType.simpleString()
    known: dict[int, tuple] = {}
    coming: dict[int, list[int]] = {}
    todo: list[int] | None = None
    while todo is None or todo:
        part = rows if todo is None else rows.where(F.col(SLICE).isin(todo))
        for r in part.mapInPandas(ends(coming), f"slice int, first {kind}, last {kind}, held array<long>").collect():
            known[r.slice] = (r["first"], r["last"], r["held"])
        numbers = sorted(known)
        now = {b: known[a][2] for a, b in zip(numbers, numbers[1:]) if known[a][1] == known[b][0]}
        todo = [n for n in now if now[n] != coming.get(n, [])]
        coming = now

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict = {}
        for batch in batches:
            outcomes = gates(coming, batch, at)
            yield batch.drop(columns=SLICE).assign(outcome=outcomes)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    return rows.select(*requests.columns, SLICE).mapInPandas(decide, f"{kinds}, outcome string")

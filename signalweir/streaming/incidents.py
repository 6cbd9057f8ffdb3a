"""Incidents on a stream: one keyed state per (tenant, fingerprint).

Takes escalated signals with tenant_id, fingerprint, signal_id, created_at; emits the same
events as the batch operator `attach_signals`, and a resolved event once silence has passed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalweir.operators.lifecycle import COOLDOWN_MINUTES, SILENCE_MINUTES

EVENTS = (
    "tenant_id string, fingerprint string, incident_id string, event_type string, "
    "event_us long, signal_no long, signal_id long"
)
#: Events that are handed on at once.
CHUNK = 10_000
_STATE = "incident_id string, last_us long, signals long, resolved boolean"


class IncidentProcessor(StatefulProcessor):
    """Decides attach, reopen or open from the gap to the last signal; timers only close and forget."""

    def __init__(self, silence_minutes: int, cooldown_minutes: int):
        self.silence = silence_minutes * 60_000_000
        self.cooldown = cooldown_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tenant, fingerprint = key
        # of a key's rows only two numbers each are held, however wide they are
        parts = [(f["created_at"].astype("datetime64[us]").astype("int64").to_numpy(), f["signal_id"].to_numpy(np.int64)) for f in rows]
        times, ids = (np.concatenate(x) for x in zip(*parts))
        del parts
        held = self.state.get() if self.state.exists() else None
        out = []
        for i in np.lexsort((ids, times)):
            us, signal_id = int(times[i]), int(ids[i])
            gap = None if held is None else us - held[1]
            if gap is not None and gap > self.silence and not held[3]:
                out.append((held[0], "resolved", held[1] + self.silence, held[2], None))
            if gap is None or gap >= self.silence + self.cooldown:
                digest = hashlib.sha256(f"{tenant}|{fingerprint}|{us}".encode()).hexdigest()
                held, kind = (digest, us, 1, False), "incident-opened"
            else:
                kind = "incident-reopened" if gap > self.silence else "signal-attached"
                held = (held[0], max(us, held[1]), held[2] + 1, False)
            out.append((held[0], kind, us, held[2], signal_id))
            if len(out) >= CHUNK:
                yield self._frame(key, out)
                out = []
        self.state.update(tuple(held))
        self._arm(held[1] + self.silence)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            incident, last, signals, resolved = self.state.get()
            now = expiredTimerInfo.getExpiryTimeInMs() * 1000
            if not resolved and now > last + self.silence:
                out.append((incident, "resolved", last + self.silence, signals, None))
                self.state.update((incident, last, signals, True))
                self._arm(last + self.silence + self.cooldown)
            elif resolved and now > last + self.silence + self.cooldown:
                self.state.clear()
        yield self._frame(key, out)

    def _arm(self, due_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due_us // 1000 + 1)

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["incident_id", "event_type", "event_us", "signal_no", "signal_id"])
        frame["signal_id"] = frame["signal_id"].astype("Int64")
        frame.insert(0, "fingerprint", key[1])
        frame.insert(0, "tenant_id", key[0])
        return frame

    def close(self) -> None:
        pass


def stream_incidents(
    escalated: DataFrame,
    silence_minutes: int = SILENCE_MINUTES,
    cooldown_minutes: int = COOLDOWN_MINUTES,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Lifecycle events of a stream of escalated signals.  Rows later than `lateness` are dropped by
    the watermark; `ledger.block_ledger` keeps them and gives the incidents of all signals."""
    rows = escalated.select("tenant_id", "fingerprint", "signal_id", "created_at").withWatermark("created_at", lateness)
    return rows.groupBy("tenant_id", "fingerprint").transformWithStateInPandas(
        statefulProcessor=IncidentProcessor(silence_minutes, cooldown_minutes),
        outputStructType=EVENTS,
        outputMode="append",
        timeMode="eventTime",
    )

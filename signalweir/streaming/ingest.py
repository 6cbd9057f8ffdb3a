"""Alert stream to decisions, and payload dedup on a stream; same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.functions.text import content_hash
from signalweir.operators.triage import triage
from signalweir.sources.alerts import normalize_signals, split_payloads


def stream_decisions(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, rejects) of a stream of tenant_id, signal_id, created_at, body."""
    accepted, rejected = split_payloads(payloads)
    return triage(normalize_signals(accepted)), rejected


def stream_dedupe(payloads: DataFrame, body: str = "body", lateness: str = "1 hour") -> DataFrame:
    """First arrival of each (tenant, incident, payload hash) inside the watermark."""
    hashed = payloads.withColumn("input_hash", content_hash(F.col(body)))
    return hashed.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(
        ["tenant_id", "incident_id", "input_hash"]
    )

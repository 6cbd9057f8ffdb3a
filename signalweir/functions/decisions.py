"""Column expressions for routing decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence from which a report is closed, or only flagged.
AUTO_RESOLVE_FROM = 85
HUMAN_REVIEW_FROM = 60
DEEP_PASS_BELOW = 80


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def _ladder(confidence: Column, high: object, middle: object, low: object) -> Column:
    score = F.coalesce(confidence, F.lit(0))
    return (
        F.when(score >= AUTO_RESOLVE_FROM, F.lit(high)).when(score >= HUMAN_REVIEW_FROM, F.lit(middle)).otherwise(F.lit(low))
    )


def escalation_tier(confidence: Column) -> Column:
    return _ladder(confidence, "auto-resolve", "human-review", "request-telemetry")


def escalation_action(confidence: Column) -> Column:
    return _ladder(confidence, "notify", "flag", "request-data")


def requires_human(confidence: Column) -> Column:
    return _ladder(confidence, False, True, True)


def needs_deep_pass(truncated: Column, confidence: Column) -> Column:
    """Only part of the evidence was seen and the answer was unsure."""
    return truncated & (F.coalesce(confidence, F.lit(0)) < DEEP_PASS_BELOW)

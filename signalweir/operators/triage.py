"""Signal triage: score, threshold, decide; and the reads over decided signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.functions import signals as S


def triage(signals: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Score every signal and decide whether it escalates.  Narrow: no shuffle, no state.

    `costs` (tenant_id, false_positive, false_negative) overrides the default costs per
    tenant; tenants it does not list keep the defaults.
    """
    scored = (
        signals.withColumn("severity_value", S.severity_ordinal(F.col("severity")))
        .withColumn("keywords", S.keyword_count(F.col("title"), F.col("message")))
        .withColumn("resolved", (F.col("state") == "resolved").cast("int"))
        .withColumn("breach", F.coalesce(F.col("breached"), F.lit(False)).cast("int"))
        .withColumn(
            "score",
            S.anomaly_score(F.col("severity_value"), F.col("keywords"), F.col("resolved"), F.col("breach")),
        )
    )
    fp, fn = F.lit(S.COST_FALSE_POSITIVE), F.lit(S.COST_FALSE_NEGATIVE)
    if costs is not None:
        scored = scored.join(costs.select("tenant_id", "false_positive", "false_negative"), "tenant_id", "left")
        fp, fn = F.coalesce(F.col("false_positive"), fp), F.coalesce(F.col("false_negative"), fn)
    return (
        scored.withColumn("threshold", S.cost_threshold(fp, fn))
        .drop("false_positive", "false_negative")
        .withColumn("escalated", F.col("score") > F.col("threshold"))
        .withColumn("fingerprint", S.fingerprint(F.col("tenant_id"), F.col("entity")))
        .withColumn("excerpt", S.excerpt(F.col("title"), F.col("message")))
    )


def split_decisions(triaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(escalated, suppressed)."""
    return triaged.where("escalated"), triaged.where("NOT escalated")


def by_decision(triaged: DataFrame, decision: str = "all") -> DataFrame:
    if decision == "all":
        return triaged
    if decision not in ("escalated", "suppressed"):
        raise ValueError(f"unknown decision {decision!r}")
    return triaged.where(F.col("escalated") == F.lit(decision == "escalated"))


def list_signals(triaged: DataFrame, tenant_id: str, decision: str = "all", limit: int = 50) -> DataFrame:
    """One tenant's newest signals (a top-k report)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = by_decision(triaged.where(F.col("tenant_id") == tenant_id), decision)
    return rows.orderBy(F.col("created_at").desc(), F.col("signal_id").desc()).limit(limit)


def suppression_summary(triaged: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Totals and the share of signals that never escalated.  Map-side partial counts only."""
    labeled = F.count("label") if "label" in triaged.columns else F.lit(0).cast("bigint")
    out = triaged.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("escalated").alias("escalated"),
        labeled.alias("labeled"),
        F.max("threshold").alias("threshold"),
    )
    suppressed = F.col("total") - F.col("escalated")
    return out.withColumn("suppressed", suppressed).withColumn(
        "suppression_rate", F.try_divide(suppressed, F.col("total"))
    )


def apply_labels(signals: DataFrame, label_log: DataFrame) -> DataFrame:
    """Stamp each signal with its last label; a label of another tenant never applies.

    `label_log`: tenant_id, signal_id, label, labeled_at.  The log is reduced to one row
    per signal by a hash aggregate before it meets the signals.
    """
    valid = label_log.where(F.col("label").isin("incident", "noise"))
    last = valid.groupBy("tenant_id", "signal_id").agg(
        F.max_by("label", F.struct("labeled_at", "label")).alias("label"),
        F.max("labeled_at").alias("labeled_at"),
    )
    return signals.drop("label", "labeled_at").join(last, ["tenant_id", "signal_id"], "left")

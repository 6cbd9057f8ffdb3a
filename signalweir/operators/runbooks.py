"""Runbook steps: scores, merit rank, execution order, library."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweir.functions.decisions import round_half_up
from signalweir.operators.merge import latest_rows

TIE_POINTS = 5.0
CLEAR_LEAD = 20.0
DANGEROUS_BLAST = 8
DEFAULT_BLAST = 5


def _pick(c: str, table: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, value in table.items():
        out = F.when(F.col(c) == name, F.lit(float(value))).otherwise(out)
    return out


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def score_steps(steps: DataFrame) -> DataFrame:
    """Composite score of each step: row-local arithmetic."""
    recovery = F.lit(100.0) / (F.lit(1.0) + _zero("recovery_minutes") / 15)
    blast = F.coalesce(F.col("blast_radius").cast("double"), F.lit(float(DEFAULT_BLAST)))
    safety = (F.lit(11.0) - blast) / 10 * 100
    undo = _pick("reversibility", {"easy": 100, "hard": 50}, 0)
    evidence = _pick("evidence_quality", {"high": 100, "medium": 60}, 25)
    trust = _pick("confidence", {"high": 1.0, "medium": 0.85}, 0.70)
    diagnostic = 0.45 * _zero("decision_value") + 0.20 * safety + 0.15 * undo + 0.20 * evidence
    remedy = (
        0.35 * _zero("success_probability")
        + 0.15 * _zero("root_cause_probability")
        + 0.15 * recovery
        + 0.15 * safety
        + 0.10 * undo
        + 0.10 * evidence
    )
    base = F.when(F.col("step_type") == "diagnostic", diagnostic).otherwise(remedy)
    return steps.withColumn("composite", base * trust).withColumn("composite_score", round_half_up(F.col("composite")))


def rank_steps(scored: DataFrame, tie_points: float = TIE_POINTS) -> DataFrame:
    """Merit rank per report.

    Steps whose sorted neighbours lie within the tie points share a cluster; inside it the
    smaller blast radius, the easier undo and the better evidence go first.  A report's steps
    are one model answer, so its window is small by nature.
    """
    w = Window.partitionBy("report_id").orderBy(F.col("composite").desc(), F.col("step_id").asc())
    gap = F.lag("composite").over(w) - F.col("composite")
    cluster = F.sum((gap > tie_points).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    blast = F.coalesce("blast_radius", F.lit(DEFAULT_BLAST))
    undo = _pick("reversibility", {"easy": 0, "hard": 1, "impossible": 2}, 3)
    evidence = _pick("evidence_quality", {"high": 0, "medium": 1, "low": 2}, 3)
    merit = Window.partitionBy("report_id").orderBy(
        F.col("_cluster").asc(), blast.asc(), undo.asc(), evidence.asc(), F.col("composite").desc(), F.col("step_id").asc()
    )
    return (
        scored.withColumn("_cluster", F.coalesce(cluster, F.lit(0)))
        .withColumn("rank", F.row_number().over(merit).cast("bigint"))
        .drop("_cluster")
    )


def recommended_actions(ranked: DataFrame) -> DataFrame:
    """First action, riskiest and best step per report.

    A far-reaching step that cannot be undone may only go first when it leads every other
    step by 20 points.
    """
    top = Window.partitionBy("report_id").orderBy(F.col("composite").desc(), F.col("step_id").asc())
    whole = top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.when(F.row_number().over(top) == 1, F.nth_value("composite", 2).over(whole)).otherwise(
        F.first("composite").over(whole)
    )
    blast = F.coalesce("blast_radius", F.lit(DEFAULT_BLAST))
    dangerous = (blast >= DANGEROUS_BLAST) & F.coalesce(F.col("reversibility") == "impossible", F.lit(False))
    clear = F.col("_other").isNull() | (F.col("composite") - F.col("_other") >= CLEAR_LEAD)
    rows = ranked.withColumn("_other", other).withColumn("_eligible", ~dangerous | clear)
    by_rank = F.col("rank")
    risk = F.struct(-F.coalesce("blast_radius", F.lit(0)), "step_id")
    return rows.groupBy("report_id").agg(
        F.coalesce(
            F.min_by("step_id", F.when(F.col("_eligible"), by_rank)), F.min_by("step_id", by_rank)
        ).alias("first_action"),
        F.min_by("step_id", risk).alias("highest_risk_action"),
        F.min_by("step_id", by_rank).alias("highest_confidence_action"),
        F.count("*").alias("steps"),
    )


def execution_order(ranked: DataFrame) -> DataFrame:
    """report_id, step_id, position: dependencies before dependants, merit order otherwise.

    `ranked` carries dependencies (array of step ids); unknown ids and cycles are skipped.
    Depth-first order cannot be told by columns, so each report is ordered by a small loop.
    """
    id_kind = ranked.schema["step_id"].dataType.simpleString()
    report_kind = ranked.schema["report_id"].dataType.simpleString()

    def order(steps: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values("rank")
        needs = {s: list(d) if d is not None else [] for s, d in zip(steps["step_id"], steps["dependencies"])}
        placed: list = []
        state: dict = {}
        for start in needs:
            path = [(start, iter(needs[start]))] if start not in state else []
            state.setdefault(start, "open")
            while path:
                step, waiting = path[-1]
                for need in waiting:
                    if need in needs and need not in state:
                        state[need] = "open"
                        path.append((need, iter(needs[need])))
                        break
                else:
                    state[step] = "done"
                    placed.append(step)
                    path.pop()
        return pd.DataFrame(
            {"report_id": steps["report_id"].iloc[0], "step_id": placed, "position": range(1, len(placed) + 1)}
        )

    rows = ranked.select("report_id", "step_id", "rank", "dependencies")
    return rows.groupBy("report_id").applyInPandas(
        order, f"report_id {report_kind}, step_id {id_kind}, position long"
    )


def runbook_library(reports: DataFrame, incidents: DataFrame) -> DataFrame:
    """Steps of the latest scored report of every incident, with where they came from.

    `reports`: report_id, incident_id, created_at, primary_component, scored_steps (array of
    structs, null when not scored); `incidents`: incident_id, tenant_id, title.
    """
    scored = reports.where("scored_steps IS NOT NULL")
    last = latest_rows(scored, ["incident_id"], [F.col("created_at"), F.col("report_id")])
    rows = last.join(incidents.select("incident_id", "tenant_id", F.col("title").alias("incident_title")), "incident_id")
    return rows.select(
        "tenant_id", "incident_id", "incident_title", "primary_component", "created_at",
        F.explode("scored_steps").alias("step"),
    ).select("tenant_id", "incident_id", "incident_title", "primary_component", "created_at", "step.*")


def library_counts(library: DataFrame) -> DataFrame:
    return library.groupBy("tenant_id").agg(
        F.count("*").alias("step_count"), F.count_distinct("incident_id").alias("incident_count")
    )

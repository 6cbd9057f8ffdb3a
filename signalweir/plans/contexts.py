"""Grounding contexts assembled for many questions, or many incidents, at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.functions.text import query_terms
from signalweir.operators import graph, logs, reporting, retrieval

JOINT = "\n\n===\n\n"


def question_context(
    questions: DataFrame,
    incidents: DataFrame,
    reports: DataFrame,
    placed: DataFrame,
    chunks: DataFrame,
    memory: DataFrame,
    graph_rows: DataFrame,
) -> DataFrame:
    """query_id, context and what went into it, for questions about incidents.

    `questions`: query_id, incident_id, tenant_id, collection, query_text, embedding.
    `incidents`: incident_id, title, status.  `reports`: incident_id, report_id, ai_payload,
    created_at.  `placed`: fused lines with positions.  `memory`: tenant_id, incident_id,
    embedding, summary, primary_component, severity.  `graph_rows`: from `graph_context`.
    """
    last = reporting.latest_reports(reporting.parse_payload(reports)).where("ai_payload IS NOT NULL").select(
        "incident_id", reporting.report_summary(F.col("payload")).alias("_summary")
    )
    excerpts = logs.keyword_excerpt(
        placed,
        questions.select(F.col("query_id").alias("question_id"), "incident_id", query_terms(F.col("query_text")).alias("terms")),
    ).select(F.col("question_id").alias("query_id"), F.col("excerpt").alias("_excerpt"))

    hits = retrieval.retrieve_hybrid(questions, chunks, k=4)
    blocks = retrieval.cited_blocks(hits, chunks, max_chars=3500, min_score=0.15)
    runbook = retrieval.pack_context(blocks).select("query_id", F.col("context").alias("_runbook"), F.col("sources").alias("runbook_sources"))

    near = _similar_for_questions(questions, memory)
    similar = reporting.similar_block(near.withColumnRenamed("query_id", "incident_id")).select(
        F.col("incident_id").alias("query_id"), F.col("block").alias("_similar")
    )
    similar_n = near.groupBy("query_id").agg(F.count("*").alias("similar_incidents"))

    heads = logs.fused_head(placed, 4000)
    texts = questions.join(heads, "incident_id", "left").select(
        F.col("query_id").alias("text_id"), "tenant_id", F.concat_ws("\n", "query_text", F.coalesce("head", F.lit(""))).alias("text")
    )
    best = graph.best_graph_context(texts, graph_rows).select(
        F.col("text_id").alias("query_id"), "tenant_id", F.col("component").alias("graph_component")
    )
    named = best.select("tenant_id", F.col("graph_component").alias("component")).distinct()
    history = reporting.context_block(graph_rows.join(named, ["tenant_id", "component"], "left_semi")).select(
        "tenant_id", F.col("component").alias("graph_component"), F.col("block").alias("_graph")
    )
    graph_part = best.join(history, ["tenant_id", "graph_component"]).drop("tenant_id")

    rows = (
        questions.select("query_id", "incident_id")
        .join(incidents.select("incident_id", "title", "status"), "incident_id", "left")
        .join(last, "incident_id", "left")
        .join(excerpts, "query_id", "left")
        .join(runbook, "query_id", "left")
        .join(similar, "query_id", "left")
        .join(similar_n, "query_id", "left")
        .join(graph_part, "query_id", "left")
    )
    head = F.concat(
        F.lit("INCIDENT: "), F.coalesce("title", F.col("incident_id").cast("string")),
        F.lit("\nStatus: "), F.coalesce("status", F.lit("unknown")),
    )

    def section(label: str, column: str):
        return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), F.col(column)))

    context = F.concat_ws(
        JOINT,
        head,
        F.when(F.col("_summary").isNotNull(), F.concat(F.lit("CURRENT ROOT-CAUSE ANALYSIS:\n"), F.col("_summary"))),
        section("RELEVANT TELEMETRY FROM THIS INCIDENT (lines matching the question)", "_excerpt"),
        section("RUNBOOK & ARCHITECTURE DOC EXCERPTS (hybrid keyword + semantic retrieval)", "_runbook"),
        F.col("_similar"),
        F.col("_graph"),
    )
    return rows.select(
        "query_id",
        "incident_id",
        context.alias("context"),
        F.col("_summary").isNotNull().alias("has_report"),
        F.coalesce("runbook_sources", F.lit(0).cast("bigint")).alias("runbook_sources"),
        F.coalesce("similar_incidents", F.lit(0).cast("bigint")).alias("similar_incidents"),
        "graph_component",
    )


def _similar_for_questions(questions: DataFrame, memory: DataFrame, k: int = retrieval.MEMORY_K) -> DataFrame:
    """Nearest past incidents of each question, the question's own incident left out.

    One more than k is fetched; the own incident, if it is among them, gives up its place.
    """
    one = F.lit("incidents").alias("collection")
    found = retrieval.semantic_search(
        questions.select("query_id", "tenant_id", one, "embedding"),
        memory.select(F.col("incident_id").alias("chunk_id"), "tenant_id", one, "embedding"),
        k + 1,
    )
    own = questions.select("query_id", F.col("incident_id").alias("_own"))
    others = found.join(own, "query_id").where(F.col("chunk_id") != F.col("_own"))
    order = [F.col("similarity").desc(), F.col("chunk_id").asc()]
    best = retrieval.top_per_key(others.drop("rank"), ["query_id"], order, k)
    about = memory.select(F.col("incident_id").alias("chunk_id"), "summary", "primary_component", "severity")
    return best.where(F.col("similarity") >= retrieval.MEMORY_FLOOR).join(about, "chunk_id").select(
        "query_id", "chunk_id", "rank", "similarity", "summary", "primary_component", "severity"
    )


def analysis_context(
    prepared: DataFrame,
    placed: DataFrame,
    tenants: DataFrame,
    graph_rows: DataFrame,
    similar: DataFrame,
    runbooks: DataFrame,
    max_chars: int = logs.HEAD_CHARS,
) -> DataFrame:
    """What an analysis of each incident reads: timeline head, counts, history and runbook blocks.

    `tenants`: incident_id, tenant_id.  `similar`: rows for `similar_block`.  `runbooks`:
    incident_id, context.
    """
    stats = logs.fuse_stats(prepared, placed)
    heads = logs.fused_head(placed, max_chars)
    texts = heads.join(tenants, "incident_id").select(F.col("incident_id").alias("text_id"), "tenant_id", F.col("head").alias("text"))
    best = graph.best_graph_context(texts, graph_rows).select(
        F.col("text_id").alias("incident_id"), "tenant_id", "component"
    )
    named = best.select("tenant_id", "component").distinct()
    blocks = reporting.context_block(graph_rows.join(named, ["tenant_id", "component"], "left_semi"))
    history = best.join(blocks, ["tenant_id", "component"]).select(
        "incident_id", F.col("block").alias("_graph")
    )
    recalled = reporting.similar_block(similar).select("incident_id", F.col("block").alias("_similar"))
    note = F.format_string(
        "\n[... telemetry truncated at %d chars — %d total lines fused ...]", F.lit(max_chars), F.col("line_count")
    )
    truncated = F.col("chars") > max_chars
    return (
        heads.join(stats, "incident_id")
        .join(history, "incident_id", "left")
        .join(recalled, "incident_id", "left")
        .join(runbooks.select("incident_id", F.col("context").alias("runbook_context")), "incident_id", "left")
        .select(
            "incident_id",
            F.when(truncated, F.concat("head", note)).otherwise(F.col("head")).alias("head"),
            truncated.alias("truncated"),
            "line_count",
            "source_count",
            F.concat_ws("\n\n", "_graph", "_similar").alias("historical_memory"),
            F.coalesce("runbook_context", F.lit("")).alias("runbook_context"),
        )
    )

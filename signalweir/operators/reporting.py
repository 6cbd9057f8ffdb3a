"""Reads over incidents, reports, chats and members; outbox and feed rows; prompt blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.functions.decisions import escalation_tier
from signalweir.functions.text import WS, embedding_input, strip_ws
from signalweir.operators.beliefs import SILENT_AGREEMENT
from signalweir.operators.merge import latest_rows
from signalweir.schemas import REPORT_PAYLOAD
from signalweir.scale import top_per_key

TRANSCRIPT_LIMIT = 30
SUMMARY_STEPS = 6


def parse_payload(reports: DataFrame, column: str = "ai_payload") -> DataFrame:
    """Add `payload`, the typed form of the JSON report."""
    return reports.withColumn("payload", F.from_json(F.col(column), REPORT_PAYLOAD))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report per incident, by a partial aggregate."""
    return latest_rows(reports, ["incident_id"], [F.col("created_at"), F.col("report_id")])


def reports_for(reports: DataFrame, incidents: DataFrame) -> DataFrame:
    """Reports of the listed incidents, newest first."""
    hits = reports.join(incidents.select("incident_id").distinct(), "incident_id", "left_semi")
    return hits.orderBy(F.col("created_at").desc(), F.col("report_id").desc())


def incident_list(incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """Incidents, newest first, with what their latest report says; missing reports leave nulls and 'no-report'."""
    last = latest_reports(parse_payload(reports)).select(
        "incident_id",
        F.col("status").alias("_status"),
        F.col("payload.incidentFingerprint.severityLevel").alias("severity"),
        F.col("payload.incidentFingerprint.primaryFailingComponent").alias("primary_component"),
        F.col("payload.confidenceMatrix.overallScore").alias("confidence"),
    )
    signal_driven = F.col("fingerprint").isNotNull() & (F.col("fingerprint") != "")
    return (
        incidents.join(last, "incident_id", "left")
        .withColumn("origin", F.when(signal_driven, F.lit("signal")).otherwise(F.lit("manual")))
        .withColumn("report_status", F.coalesce("_status", F.lit("no-report")))
        .drop("_status")
        .orderBy(F.col("created_at").desc(), F.col("incident_id").desc())
    )


def _json_number(column: str, field: str) -> Column:
    return F.get_json_object(F.col(column), f"$.{field}").try_cast("double")


def uncertain_reports(reports: DataFrame, at_least: float) -> DataFrame:
    """Reports whose belief is at least this uncertain."""
    rows = reports.withColumn("uncertainty", _json_number("hypotheses", "uncertainty"))
    return rows.where(F.col("uncertainty") >= at_least)


def contested_reports(reports: DataFrame) -> DataFrame:
    """Reports with a consensus, how far the voters began apart, and a mark when they never differed."""
    rows = reports.withColumn("disagreement", _json_number("consensus", "initialDisagreement"))
    rows = rows.where(F.col("disagreement").isNotNull())
    return rows.withColumn("suspicious", F.col("disagreement") < SILENT_AGREEMENT)


def transcript(messages: DataFrame, limit: int = TRANSCRIPT_LIMIT) -> DataFrame:
    """The last `limit` messages per incident, numbered oldest first."""
    last = top_per_key(messages, ["incident_id"], [F.col("turn").desc()], limit, "_back")
    kept = last.groupBy("incident_id").agg(F.max("_back").alias("_n"))
    return last.join(kept, "incident_id").withColumn("position", F.col("_n") - F.col("_back") + 1).drop("_back", "_n")


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    return memberships.join(users, "user_id")


def user_orgs(memberships: DataFrame, organizations: DataFrame) -> DataFrame:
    """Memberships with the organization's name where it still exists."""
    return memberships.join(organizations, "organization_id", "left")


def event_feed(rows: DataFrame, incident: str = "incident_id", at: str = "event_at") -> DataFrame:
    """One (key, value) row per event, ready for a keyed sink."""
    rest = [c for c in rows.columns if c not in (incident, at)]
    body = F.struct(
        *rest,
        F.col(incident).alias("incidentId"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
    )
    key = F.concat(F.lit("incident:"), F.col(incident).cast("string"))
    return rows.select(key.alias("key"), F.to_json(body).alias("value"))


def notification_outbox(reports: DataFrame) -> DataFrame:
    """Message blocks for reports that close themselves; nothing is sent from here."""
    rows = reports if "payload" in reports.columns else parse_payload(reports)
    score = F.coalesce(F.col("payload.confidenceMatrix.overallScore"), F.lit(0.0))
    about, cause = F.col("payload.incidentFingerprint"), F.col("payload.rootCauseAnalysis")

    def field(label: str, value: Column) -> Column:
        text = F.concat(F.lit(f"*{label}:*\n"), value)
        return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))

    def block(kind: str, text: Column | None = None, fields: Column | None = None, elements: Column | None = None) -> Column:
        pair = "struct<type:string,text:string>"
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("type"),
            (none.cast(pair) if text is None else text).alias("text"),
            (none.cast(f"array<{pair}>") if fields is None else fields).alias("fields"),
            (none.cast(f"array<{pair}>") if elements is None else elements).alias("elements"),
        )

    heading = F.concat(F.lit("RCA — "), F.coalesce(about["severityLevel"], F.lit("UNKNOWN")))
    confidence = F.concat(round_text(score), F.lit("/100 ("), escalation_tier(score), F.lit(")"))
    action = F.coalesce(F.get(F.col("payload.actionableRunbook.mitigationSteps"), F.lit(0))["action"], F.lit("No action available"))
    history = about["historicalCorrelation"]
    recurring = (F.coalesce(history, F.lit("")) != "") & ~history.startswith("First occurrence")
    origin = F.concat(F.lit("Incident `"), F.col("incident_id").cast("string"), F.lit("`"))
    blocks = F.concat(
        F.array(
            block("header", F.struct(F.lit("plain_text").alias("type"), heading.alias("text"))),
            block(
                "section",
                fields=F.array(
                    field("Primary Component", F.coalesce(about["primaryFailingComponent"], F.lit("unknown"))),
                    field("Confidence", confidence),
                ),
            ),
            block("section", field("Root Cause", F.coalesce(cause["definitiveRootCause"], F.lit("unknown")))),
            block("section", field("Recommended First Action", action)),
        ),
        F.when(recurring, F.array(block("section", field("Recurring Pattern", history)))).otherwise(F.array().cast(
            "array<struct<type:string,text:struct<type:string,text:string>,fields:array<struct<type:string,text:string>>,"
            "elements:array<struct<type:string,text:string>>>>"
        )),
        F.array(block("context", elements=F.array(F.struct(F.lit("mrkdwn").alias("type"), origin.alias("text"))))),
    )
    return rows.where(escalation_tier(score) == "auto-resolve").select(
        "incident_id", "report_id", recurring.alias("recurring"), F.size(blocks).alias("block_count"),
        F.to_json(F.struct(blocks.alias("blocks"))).alias("message"),
    )


def round_text(score: Column) -> Column:
    """A number as text, without a decimal point when it is whole."""
    whole = score == F.floor(score)
    return F.when(whole, score.cast("bigint").cast("string")).otherwise(score.cast("string"))


def report_summary(payload: Column) -> Column:
    """The few lines of a report an engineer reads first; empty parts are left out."""
    about, cause = payload["incidentFingerprint"], payload["rootCauseAnalysis"]
    steps = F.slice(F.coalesce(payload["actionableRunbook"]["mitigationSteps"], F.array().cast("array<struct<action:string,cliCommand:string>>")), 1, SUMMARY_STEPS)

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    def step_line(s: Column, i: Column) -> Column:
        command = F.when(F.coalesce(s["cliCommand"], F.lit("")) != "", F.concat(F.lit(" [`"), s["cliCommand"], F.lit("`]")))
        return F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.coalesce(s["action"], F.lit("")), F.coalesce(command, F.lit(""))
        )

    listed = F.when(F.size(steps) > 0, F.concat(F.lit("Current mitigation steps:\n"), F.array_join(F.transform(steps, step_line), "\n")))
    return F.concat_ws(
        "\n",
        line("Summary", about["executiveSummary"]),
        line("Primary failing component", about["primaryFailingComponent"]),
        line("Severity", about["severityLevel"]),
        line("Root cause", cause["definitiveRootCause"]),
        listed,
    )


RECALL_ADVICE = "- Where one of these matches, say so, start from its cause and steps, and weigh the confidence by it."
HISTORY_ADVICE = "- Weigh the confidence and the root cause against this history."


def similar_block(similar: DataFrame, title: str = "SIMILAR PAST INCIDENTS", closing: str = RECALL_ADVICE) -> DataFrame:
    """Text block per incident over its recalled neighbours: incident_id, rank, similarity, summary,
    primary_component, severity.  `closing` is the last line; empty leaves it out."""
    severity = F.when(F.coalesce("severity", F.lit("")) != "", F.concat(F.lit(" "), "severity")).otherwise(F.lit(""))
    summary = strip_ws(F.regexp_replace(F.coalesce("summary", F.lit("")), f"{WS}+", " "))
    line = F.concat(
        F.lit("- ["), F.format_string("%.0f", F.col("similarity") * 100), F.lit("% similar]"), severity, F.lit(" "),
        F.coalesce("primary_component", F.lit("unknown component")), F.lit(" — "), summary,
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda e: e["line"])
    return similar.groupBy("incident_id").agg(F.concat_ws("\n", F.lit(f"{title}:"), F.array_join(lines, "\n"), F.lit(closing or None)).alias("block"))


def context_block(context: DataFrame, title: str = "FAILURE HISTORY", closing: str = HISTORY_ADVICE) -> DataFrame:
    """Text block per component over its known downstream failures, most frequent first, and a last line."""
    line = F.concat(
        F.lit("  • "), F.col("downstream"), F.lit(" — failed "), F.col("occurrence_count").cast("string"), F.lit("x (last seen: "),
        F.date_format("last_seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(")"),
    )
    entry = F.struct((-F.col("occurrence_count")).alias("o"), "downstream", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"])
    heading = F.concat(
        F.lit(f"{title} ("), F.col("component").cast("string"), F.lit("):\n- Primary failure source in "),
        F.col("total_incidents").cast("string"), F.lit(" previous incident(s).\n- Known blast radius:"),
    )
    return (
        context.groupBy("tenant_id", "component", "total_incidents")
        .agg(F.array_join(lines, "\n").alias("_lines"))
        .select("tenant_id", "component", F.concat_ws("\n", heading, "_lines", F.lit(closing or None)).alias("block"))
    )


def embedding_inputs(heads: DataFrame, reports: DataFrame, incidents: DataFrame) -> DataFrame:
    """What to embed for every completed report: the head of the incident's timeline and its labels.

    `heads`: incident_id, head; incidents without evidence are skipped.
    """
    done = parse_payload(reports.where("status = 'completed' AND ai_payload IS NOT NULL"))
    about = F.col("payload.incidentFingerprint")
    return (
        done.join(incidents.select("incident_id", "tenant_id"), "incident_id")
        .join(heads, "incident_id")
        .select(
            F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"),
            "incident_id",
            "report_id",
            F.coalesce(about["executiveSummary"], F.col("payload.rootCauseAnalysis.definitiveRootCause")).alias("summary"),
            about["primaryFailingComponent"].alias("primary_component"),
            about["severityLevel"].alias("severity"),
            embedding_input(F.col("head")).alias("embedding_text"),
        )
        .where("embedding_text <> ''")
    )


def segment_digest(digests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings of the chunks of an incident as one text; chunks without findings are left out.

    `digests`: incident_id, chunk_index, digest.  A chunk set is capped upstream, so is the text.
    """
    total = chunks.groupBy("incident_id").agg(F.count("*").alias("_n"))
    head = F.format_string("--- SEGMENT %d/%d FINDINGS ---\n", F.col("chunk_index") + 1, F.col("_n"))
    rows = digests.where("digest IS NOT NULL AND digest <> ''").join(total, "incident_id")
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_index", F.concat(head, "digest").alias("part")))), lambda e: e["part"]
    )
    return rows.groupBy("incident_id").agg(F.array_join(parts, "\n\n").alias("digest"))

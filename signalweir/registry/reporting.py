"""Queries over reports, incidents, chats, members, payloads and fenced writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweir.functions import decisions as D
from signalweir.functions.text import query_terms
from signalweir.operators import admission, graph, lifecycle, logs, merge, reporting, retrieval, runbooks
from signalweir.plans import contexts, evidence
from signalweir.registry.base import duck_stamp, query, rounded, stamp
from signalweir.registry.documents import _duck_tokens
from signalweir.registry.logs import _FUSE
from signalweir.registry.signals import escalated
from signalweir.registry.views import table, view, with_views

_CELLS = """SELECT *, CASE status WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS report_state,
  CASE confidence % 3 WHEN 0 THEN 'SEV1' WHEN 1 THEN 'SEV2' END AS severity, concat('svc-', CAST(incident_id % 10 AS STRING)) AS component,
  concat('root cause ', CAST(report_id % 50 AS STRING)) AS cause,
  CASE WHEN report_id % 3 = 0 THEN 'First occurrence here' ELSE concat('seen ', CAST(report_id % 7 AS STRING), ' times') END AS history,
  CASE WHEN report_id % 4 = 0 THEN '' ELSE concat('summary ', CAST(report_id AS STRING)) END AS headline,
  concat('restart ', CAST(incident_id % 10 AS STRING)) AS action FROM {source}"""
_DUCK_CELLS = f"cells AS ({_CELLS.format(source='v_reports')})"
_LAST = f"""{_DUCK_CELLS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, report_id DESC) AS rn FROM cells) WHERE rn = 1)"""


def _reports(spark, sf_dir):
    """Reports with their JSON columns, as a store would hold them."""
    cells = spark.sql(_CELLS, source=view(spark, sf_dir, "v_reports"))
    payload = F.to_json(
        F.struct(
            F.struct(
                F.col("headline").alias("executiveSummary"), F.col("component").alias("primaryFailingComponent"),
                F.col("severity").alias("severityLevel"), F.col("history").alias("historicalCorrelation"),
            ).alias("incidentFingerprint"),
            F.struct(F.col("cause").alias("definitiveRootCause")).alias("rootCauseAnalysis"),
            F.struct(
                F.array(F.struct("action", F.lit("kubectl get pods").alias("cliCommand")), F.struct(F.lit("watch").alias("action"), F.lit(None).cast("string").alias("cliCommand"))).alias("mitigationSteps")
            ).alias("actionableRunbook"),
            F.struct(F.col("confidence").alias("overallScore")).alias("confidenceMatrix"),
        )
    )
    return cells.select(
        "report_id", "incident_id", "tenant_id", F.col("report_state").alias("status"), F.col("created_at").cast("timestamp").alias("created_at"),
        payload.alias("ai_payload"),
        F.to_json(F.struct(((F.col("report_id") % 100) / 100).alias("uncertainty"))).alias("hypotheses"),
        F.when(F.col("report_id") % 2 == 0, F.to_json(F.struct(((F.col("report_id") % 200) / 1000).alias("initialDisagreement")))).alias("consensus"),
    )


@query(
    "w4_latest_reports",
    with_views(["v_reports"], _LAST + f" SELECT incident_id, report_id, report_state AS status, {duck_stamp('created_at')} AS created_at FROM last"),
)
def latest_reports(spark, sf_dir):
    out = reporting.latest_reports(_reports(spark, sf_dir))
    return out.select("incident_id", "report_id", "status", stamp("created_at").alias("created_at"))


@query(
    "j5_incident_list",
    with_views(
        ["v_reports", "v_incidents"],
        _LAST
        + """ SELECT i.incident_id, i.title, CASE WHEN i.fingerprint IS NULL THEN 'manual' ELSE 'signal' END AS origin, coalesce(l.report_state, 'no-report') AS report_status,
  l.severity, l.component AS primary_component, CAST(l.confidence AS DOUBLE) AS confidence FROM v_incidents i LEFT JOIN last l ON l.incident_id = i.incident_id""",
    ),
)
def incident_list(spark, sf_dir):
    out = reporting.incident_list(view(spark, sf_dir, "v_incidents"), _reports(spark, sf_dir))
    return out.select("incident_id", "title", "origin", "report_status", "severity", "primary_component", "confidence")


@query(
    "p8_reports_of_incidents",
    with_views(
        ["v_reports", "v_incidents"],
        "SELECT report_id, incident_id FROM v_reports WHERE incident_id IN (SELECT incident_id FROM v_incidents WHERE status = 'resolved')",
    ),
)
def reports_of_incidents(spark, sf_dir):
    wanted = view(spark, sf_dir, "v_incidents").where("status = 'resolved'")
    return reporting.reports_for(_reports(spark, sf_dir), wanted).select("report_id", "incident_id")


@query(
    "p13_uncertain_reports",
    with_views(["v_reports"], "SELECT report_id, round((report_id % 100) / 100, 6) AS uncertainty FROM v_reports WHERE report_id % 100 >= 72"),
)
def uncertain(spark, sf_dir):
    return rounded(reporting.uncertain_reports(_reports(spark, sf_dir), 0.72).select("report_id", "uncertainty"), "uncertainty")


@query(
    "p14_contested_reports",
    with_views(
        ["v_reports"],
        "SELECT report_id, round((report_id % 200) / 1000, 6) AS disagreement, report_id % 200 < 10 AS suspicious FROM v_reports WHERE report_id % 2 = 0",
    ),
)
def contested(spark, sf_dir):
    return rounded(reporting.contested_reports(_reports(spark, sf_dir)).select("report_id", "disagreement", "suspicious"), "disagreement")


@query(
    "f33_escalation_tiers",
    with_views(
        ["v_reports"],
        """SELECT report_id, CASE WHEN confidence >= 85 THEN 'auto-resolve' WHEN confidence >= 60 THEN 'human-review' ELSE 'request-telemetry' END AS tier,
  CASE WHEN confidence >= 85 THEN 'notify' WHEN confidence >= 60 THEN 'flag' ELSE 'request-data' END AS action, confidence < 85 AS requires_human,
  report_id % 2 = 0 AND confidence < 80 AS deep_pass FROM v_reports""",
    ),
)
def tiers(spark, sf_dir):
    c = F.col("confidence")
    return view(spark, sf_dir, "v_reports").select(
        "report_id", D.escalation_tier(c).alias("tier"), D.escalation_action(c).alias("action"),
        D.requires_human(c).alias("requires_human"), D.needs_deep_pass(F.col("report_id") % 2 == 0, c).alias("deep_pass"),
    )


@query(
    "s11_notification_outbox",
    with_views(
        ["v_reports"],
        _DUCK_CELLS
        + """ SELECT incident_id, report_id, report_id % 3 <> 0 AS recurring, CASE WHEN report_id % 3 <> 0 THEN 6 ELSE 5 END AS block_count,
  concat('RCA — ', coalesce(severity, 'UNKNOWN')) AS heading, concat('*Confidence:*', chr(10), CAST(confidence AS VARCHAR), '/100 (auto-resolve)') AS confidence
FROM cells WHERE confidence >= 85""",
    ),
)
def outbox(spark, sf_dir):
    rows = reporting.notification_outbox(_reports(spark, sf_dir))
    return rows.select(
        "incident_id", "report_id", "recurring", "block_count",
        F.get_json_object("message", "$.blocks[0].text.text").alias("heading"),
        F.get_json_object("message", "$.blocks[1].fields[1].text").alias("confidence"),
    )


@query(
    "f39_report_summaries",
    with_views(
        ["v_reports"],
        _DUCK_CELLS
        + """ SELECT report_id, concat_ws(chr(10), CASE WHEN headline <> '' THEN 'Summary: ' || headline END, 'Primary failing component: ' || component,
  'Severity: ' || severity, 'Root cause: ' || cause, 'Current mitigation steps:', '  1. ' || action || ' [`kubectl get pods`]', '  2. watch') AS summary FROM cells""",
    ),
)
def report_summaries(spark, sf_dir):
    rows = reporting.parse_payload(_reports(spark, sf_dir))
    return rows.select("report_id", reporting.report_summary(F.col("payload")).alias("summary"))


def _library(spark, sf_dir):
    ranked = runbooks.rank_steps(runbooks.score_steps(view(spark, sf_dir, "v_steps")))
    step = F.struct(
        F.concat(F.lit("step "), F.col("step_id").cast("string")).alias("action"),
        F.concat(F.lit("run "), F.col("step_id").cast("string")).alias("cli_command"), "step_type", "composite_score", "rank",
        F.col("recovery_minutes").alias("recovery_time_minutes"), "blast_radius", "reversibility", "evidence_quality", "confidence",
    )
    scored = ranked.groupBy("report_id").agg(F.array_sort(F.collect_list(step)).alias("scored_steps"))
    reports = _reports(spark, sf_dir).select(
        "report_id", "incident_id", "created_at",
        F.get_json_object("ai_payload", "$.incidentFingerprint.primaryFailingComponent").alias("primary_component"),
    )
    return runbooks.runbook_library(reports.join(scored, "report_id", "left"), view(spark, sf_dir, "v_incidents"))


_LIBRARY = (
    _DUCK_CELLS
    + """, got AS (SELECT c.*, row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, report_id DESC) AS rn FROM cells c
  WHERE report_id IN (SELECT report_id FROM v_steps)),
lib AS (SELECT i.tenant_id, g.incident_id, i.title AS incident_title, g.component AS primary_component, concat('step ', CAST(s.step_id AS VARCHAR)) AS action, s.step_type,
  concat('run ', CAST(s.step_id AS VARCHAR)) AS cli_command, CAST(s.recovery_minutes AS DOUBLE) AS recovery_time_minutes, s.evidence_quality, s.confidence,
  s.blast_radius, s.reversibility, strftime(g.created_at, '%Y-%m-%d') AS created_on FROM got g JOIN v_incidents i ON i.incident_id = g.incident_id JOIN v_steps s ON s.report_id = g.report_id WHERE rn = 1)"""
)


@query("k4_runbook_library", with_views(["v_reports", "v_incidents", "v_steps"], _LIBRARY + " SELECT * FROM lib"))
def library(spark, sf_dir):
    return _library(spark, sf_dir).select(
        "tenant_id", "incident_id", "incident_title", "primary_component", "action", "cli_command", "step_type", "blast_radius", "reversibility",
        F.col("recovery_time_minutes").cast("double").alias("recovery_time_minutes"), "evidence_quality", "confidence",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
    )


@query(
    "a21_library_counts",
    with_views(
        ["v_reports", "v_incidents", "v_steps"],
        _LIBRARY + " SELECT tenant_id, count(*) AS step_count, count(DISTINCT incident_id) AS incident_count FROM lib GROUP BY 1",
    ),
)
def library_counts(spark, sf_dir):
    return runbooks.library_counts(_library(spark, sf_dir))


@query(
    "w14_transcript",
    with_views(
        ["v_chat"],
        """r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY turn DESC) AS back FROM v_chat),
k AS (SELECT * FROM r WHERE back <= 3)
SELECT incident_id, turn, role, content, row_number() OVER (PARTITION BY incident_id ORDER BY turn) AS position FROM k""",
    ),
)
def transcript(spark, sf_dir):
    return reporting.transcript(view(spark, sf_dir, "v_chat"), 3)


@query("j2_members", "SELECT c_nationkey AS user_id, c_custkey AS membership_id, n_name AS user_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def members(spark, sf_dir):
    memberships = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("membership_id"))
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("user_name"))
    return reporting.members(memberships, users)


@query(
    "j3_user_organizations",
    "SELECT s_nationkey AS organization_id, s_suppkey AS user_id, n_name AS organization_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = s_nationkey",
)
def user_organizations(spark, sf_dir):
    memberships = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("organization_id"), F.col("s_suppkey").alias("user_id"))
    orgs = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("organization_name")
    )
    return reporting.user_orgs(memberships, orgs)


@query(
    "s9_event_feed",
    with_views(
        ["v_escalated"],
        """SELECT concat('incident:', fingerprint) AS "key", signal_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp" FROM v_escalated""",
    ),
)
def event_feed(spark, sf_dir):
    rows = escalated(spark, sf_dir).select(
        F.col("fingerprint").alias("incident_id"), F.col("created_at").alias("event_at"), F.lit("signal-attached").alias("type"), "signal_id"
    )
    feed = reporting.event_feed(rows)
    return feed.select(
        "key", F.get_json_object("value", "$.signal_id").cast("bigint").alias("signal_id"), F.get_json_object("value", "$.timestamp").alias("timestamp")
    )


# --- incident lines keyed by user, so that reports and lines share incidents ---

_USER = "CAST(regexp_extract(raw, 'user([0-9]+)', 1) AS BIGINT)"
_USER_FUSE = _FUSE.replace("SELECT incident_id, source_file, line_no, raw, nullif", f"SELECT {_USER} AS incident_id, source_file, line_no, raw, nullif")


def _user_lines(spark, sf_dir):
    lines = view(spark, sf_dir, "v_log_lines")
    return lines.withColumn("incident_id", F.expr(_USER))


def _user_placed(spark, sf_dir):
    prepared = logs.prepare_lines(_user_lines(spark, sf_dir))
    return prepared, logs.positions(logs.fuse_lines(prepared))


@query(
    "s10_embedding_inputs",
    with_views(
        ["v_reports", "v_incidents", "v_log_lines"],
        _USER_FUSE
        + ", "
        + _DUCK_CELLS
        + """, heads AS (SELECT incident_id, trim(substr(string_agg(line, chr(10) ORDER BY line_index), 1, 8000)) AS head FROM placed GROUP BY 1)
SELECT i.tenant_id, c.incident_id, c.report_id, c.headline AS summary, c.component AS primary_component, c.severity, h.head AS embedding_text
FROM cells c JOIN v_incidents i ON i.incident_id = c.incident_id JOIN heads h ON h.incident_id = c.incident_id WHERE c.report_state = 'completed'""",
    ),
)
def embedding_inputs(spark, sf_dir):
    _, placed = _user_placed(spark, sf_dir)
    return reporting.embedding_inputs(
        logs.fused_head(placed, 8000), _reports(spark, sf_dir).drop("tenant_id"), view(spark, sf_dir, "v_incidents")
    )


def _line_questions(spark, sf_dir):
    """A question per turn, about one of the incidents that have lines; every other one names nothing in them."""
    asked = view(spark, sf_dir, "v_chat").withColumn("incident_id", F.col("incident_id") * 1000 + F.col("turn"))
    named = F.when(F.col("incident_id") % 2 == 0, F.lit("value=12 fatal user3 ")).otherwise(F.lit("zzzz "))
    terms = F.concat(named, F.col("content"))
    return asked.select(
        F.col("incident_id").alias("question_id"), F.concat(F.lit("inc"), (F.col("incident_id") % 40).cast("string")).alias("incident_id"),
        query_terms(terms).alias("terms"),
    )


@query(
    "p16_keyword_excerpt",
    with_views(
        ["v_log_lines", "v_chat"],
        _FUSE
        + f""", q AS (SELECT incident_id AS question_id, concat('inc', CAST(incident_id % 40 AS VARCHAR)) AS incident_id,
  list_distinct({_duck_tokens("concat(CASE WHEN incident_id % 2 = 0 THEN 'value=12 fatal user3 ' ELSE 'zzzz ' END, content)")}) AS terms
  FROM (SELECT incident_id * 1000 + turn AS incident_id, content FROM v_chat)),
t AS (SELECT question_id, incident_id, unnest(terms) AS term FROM q),
hit AS (SELECT DISTINCT t.question_id, p.line_index, p.line FROM t JOIN placed p ON p.incident_id = t.incident_id AND contains(lower(p.line), t.term)),
run AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY question_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS before FROM hit),
found AS (SELECT question_id, substr(string_agg(line, chr(10) ORDER BY line_index), 1, 2500) AS body FROM run WHERE before <= 2500 GROUP BY 1),
heads AS (SELECT incident_id, substr(string_agg(line, chr(10) ORDER BY line_index), 1, 2500) AS head FROM placed GROUP BY 1)
SELECT q.question_id, q.incident_id, coalesce(f.body, h.head, '') AS excerpt FROM q LEFT JOIN found f ON f.question_id = q.question_id LEFT JOIN heads h ON h.incident_id = q.incident_id""",
    ),
)
def keyword_excerpt(spark, sf_dir):
    placed = logs.positions(logs.fuse_lines(logs.prepare_lines(view(spark, sf_dir, "v_log_lines").drop("tenant_id"))))
    return logs.keyword_excerpt(placed, _line_questions(spark, sf_dir))


@query(
    "d8_segment_digest",
    with_views(
        ["v_chat"],
        """n AS (SELECT *, count(*) OVER (PARTITION BY incident_id) AS total FROM v_chat)
SELECT incident_id, string_agg(concat('--- SEGMENT ', CAST(turn + 1 AS VARCHAR), '/', CAST(total AS VARCHAR), ' FINDINGS ---', chr(10), content), chr(10) || chr(10) ORDER BY turn) AS digest
FROM n WHERE role <> 'user' AND content <> '' GROUP BY 1""",
    ),
)
def segment_digest(spark, sf_dir):
    chat = view(spark, sf_dir, "v_chat")
    digests = chat.select(
        "incident_id", F.col("turn").alias("chunk_index"), F.when(F.col("role") != "user", F.col("content")).alias("digest")
    )
    return reporting.segment_digest(digests, chat)


def _memory(spark, sf_dir):
    chunks = view(spark, sf_dir, "v_chunks")
    return chunks.select(
        "tenant_id", F.col("chunk_id").alias("incident_id"), "embedding", F.substring("content", 1, 120).alias("summary"),
        F.col("title").alias("primary_component"), F.lit("SEV2").alias("severity"),
    )


def _graph_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "v_findings").withColumns(
        {"hypothesis_components": F.array("hypothesis_component"), "reasoning": F.array("reasoning")}
    )
    return graph.graph_context(*graph.build_graph(graph.cascades(rows)))


@query("v8_question_context")
def question_context(spark, sf_dir):
    _, placed = _user_placed(spark, sf_dir)
    asked = view(spark, sf_dir, "v_questions")
    questions = asked.withColumn("incident_id", F.col("query_id")).withColumn(
        "query_text", F.concat_ws(" ", F.lit("kafka and redis value=12"), "query_text")
    )
    chunks = view(spark, sf_dir, "v_chunks").withColumn("heading", F.lit(None).cast("string"))
    # the monitored tenants stand for the language tenants of the questions
    language = F.create_map(F.lit("t0"), F.lit("en"), F.lit("t1"), F.lit("fr"), F.lit("t2"), F.lit("de"))
    served = _graph_rows(spark, sf_dir).withColumn("tenant_id", language[F.col("tenant_id")])
    return contexts.question_context(
        questions, view(spark, sf_dir, "v_incidents"), _reports(spark, sf_dir), placed, chunks, _memory(spark, sf_dir), served
    )


_HISTORY = "\n".join([
    "FAILURE HISTORY (redis):", "- Primary failure source in 4 previous incident(s).", "- Known blast radius:",
    "  • orders-api — failed 7x (last seen: 2024-01-01T12:00:00.000Z)", "  • ledger — failed 3x (last seen: 2024-01-01T12:00:00.000Z)",
    reporting.HISTORY_ADVICE,
])
_RECALLED = "\n".join([
    "SIMILAR PAST INCIDENTS:", "- [96% similar] SEV1 redis — pool ran dry", "- [71% similar] unknown component — b c", reporting.RECALL_ADVICE,
])


@query(
    "d9_analysis_context",
    with_views(
        ["v_named_lines"],
        _FUSE.replace("v_log_lines", "v_named_lines")
        + f""", st AS (SELECT incident_id, count(*) AS line_count, sum(length(line) + 1) - 1 AS chars, string_agg(line, chr(10) ORDER BY line_index) AS txt FROM placed GROUP BY 1),
so AS (SELECT incident_id, min(tenant_id) AS tenant_id, count(DISTINCT source_file) AS source_count, CAST(substr(incident_id, 4) AS INT) % 4 AS kind FROM v_named_lines GROUP BY 1)
SELECT st.incident_id, CASE WHEN chars > 3000 THEN concat(substr(txt, 1, 3000), chr(10), '[... telemetry truncated at 3000 chars — ', CAST(line_count AS VARCHAR), ' total lines fused ...]') ELSE txt END AS head,
  chars > 3000 AS truncated, line_count, source_count,
  concat_ws(chr(10) || chr(10), CASE WHEN tenant_id = 't0' THEN '{_HISTORY}' END, CASE WHEN kind < 2 THEN '{_RECALLED}' END) AS historical_memory,
  CASE WHEN kind = 0 THEN 'Restart the pool.' ELSE '' END AS runbook_context FROM st JOIN so ON so.incident_id = st.incident_id""",
    ),
)
def analysis_context(spark, sf_dir):
    lines = view(spark, sf_dir, "v_log_lines").withColumn("raw", F.concat("raw", F.lit(" via redis")))
    prepared = logs.prepare_lines(lines.drop("tenant_id"))
    placed = logs.positions(logs.fuse_lines(prepared))
    tenants = lines.groupBy("incident_id").agg(F.min("tenant_id").alias("tenant_id"))
    kind = F.substring("incident_id", 4, 9).cast("int") % 4
    seen = F.lit("2024-01-01 12:00:00").cast("timestamp")
    # the lines name redis; one tenant knows it, the other knows what no line names
    known = F.explode(F.array(*[F.struct(F.lit(d).alias("downstream"), F.lit(n).alias("occurrence_count")) for d, n in (("ledger", 3), ("orders-api", 7))]))
    graph_rows = tenants.select("tenant_id").distinct().select(
        "tenant_id", F.when(F.col("tenant_id") == "t0", F.lit("redis")).otherwise(F.lit("kafka")).alias("component"),
        F.lit(4).cast("bigint").alias("total_incidents"), known.alias("_k"), seen.alias("last_seen_at"),
    ).select("*", "_k.*").drop("_k")
    past = [(1, 0.956, "pool ran dry", "redis", "SEV1"), (2, 0.71, "b\n c", None, None)]
    fields = ("rank", "similarity", "summary", "primary_component", "severity")
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).cast("string" if v is None else "double" if n == "similarity" else "bigint" if n == "rank" else "string").alias(n) for n, v in zip(fields, r)]) for r in past]))
    recalled = tenants.where(kind < 2).select("incident_id", rows.alias("_r")).select("incident_id", "_r.*")
    runbook = tenants.where(kind == 0).select("incident_id", F.lit("Restart the pool.").alias("context"))
    return contexts.analysis_context(prepared, placed, tenants, graph_rows, recalled, runbook, 3000)


@query("s8_stored_evidence")
def stored_evidence(spark, sf_dir):
    lines = view(spark, sf_dir, "v_log_lines").drop("tenant_id")
    rows, _ = evidence.prepare_evidence(lines, max_bytes=100_000)
    return rows


@query(
    "s8_signal_evidence",
    with_views(
        ["v_escalated"],
        """SELECT signal_id AS text_id, 'monitor-signal' AS source_file, concat('[monitor] ', severity, ' on ', entity, chr(10), title, chr(10), message) AS text FROM v_escalated""",
    ),
)
def signal_evidence(spark, sf_dir):
    rows = evidence.signal_evidence(lifecycle.attach_signals(escalated(spark, sf_dir)))
    return rows.select("text_id", "source_file", "text")


# --- merge-shaped operators ---

_FENCED = """f AS (SELECT *, max(token) OVER (PARTITION BY report_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fence FROM v_fence),
a AS (SELECT *, fence IS NULL OR token >= fence AS accepted FROM f)"""


@query("w7_fenced_writes", with_views(["v_fence"], _FENCED + " SELECT report_id, arrival, token, accepted FROM a"))
def fenced_writes(spark, sf_dir):
    writes = view(spark, sf_dir, "v_fence").select("report_id", "token", F.col("arrival").cast("bigint").alias("arrival"))
    return merge.accepted_writes(writes).select("report_id", "arrival", "token", "accepted")


@query(
    "m3_fenced_merge",
    with_views(
        ["v_fence"],
        _FENCED
        + """ SELECT report_id, max(token) AS fence_token, count(*) AS accepted_writes, arg_max(status_value, arrival) AS status_value,
  arg_max(tier_value, arrival) FILTER (WHERE tier_value IS NOT NULL) AS tier_value FROM a WHERE accepted GROUP BY 1""",
    ),
)
def fenced_merge(spark, sf_dir):
    return merge.fenced_merge(view(spark, sf_dir, "v_fence"), ["status_value", "tier_value"])


_UNIQUE = """h AS (SELECT *, sha256(body) AS input_hash FROM v_payloads),
u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, incident_id, input_hash ORDER BY created_at, payload_id) AS rn FROM h) WHERE rn = 1)"""


def _payloads(spark, sf_dir):
    return view(spark, sf_dir, "v_payloads").withColumn("input_hash", F.sha2("body", 256))


@query("j18_deduped_payloads", with_views(["v_payloads"], _UNIQUE + " SELECT payload_id, input_hash FROM u"))
def deduped(spark, sf_dir):
    return merge.dedupe_payloads(_payloads(spark, sf_dir)).select("payload_id", "input_hash")


@query(
    "a24_running_baseline",
    with_views(
        ["v_payloads"],
        _UNIQUE
        + """, s AS (SELECT payload_id, tenant_id, CAST(sum(amount) OVER (PARTITION BY tenant_id ORDER BY created_at, payload_id) % 65536 AS BIGINT) AS baseline FROM u)
SELECT *, baseline >= 10000 AS anomaly FROM s""",
    ),
)
def running_baseline(spark, sf_dir):
    out = merge.running_baseline(merge.dedupe_payloads(_payloads(spark, sf_dir)))
    return out.select("payload_id", "tenant_id", "baseline", "anomaly")


@query(
    "m7_migrated_status",
    with_views(
        ["v_incidents"],
        """SELECT incident_id, CASE WHEN status = 'pending' THEN 'open' ELSE status END AS status,
  coalesce(fingerprint, substr(sha256(CAST(incident_id AS VARCHAR)), 1, 32)) AS slug FROM v_incidents""",
    ),
)
def migrated(spark, sf_dir):
    rows = merge.migrate_status(view(spark, sf_dir, "v_incidents")).withColumnRenamed("fingerprint", "slug")
    return merge.backfill_slugs(rows, "slug", "incident_id").select("incident_id", "status", "slug")


GATED = """WITH RECURSIVE q AS MATERIALIZED (SELECT user_id AS subject, event_id AS request_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), event_id) AS rn FROM events),
g AS (SELECT subject, request_id, ts_ms, rn, 'ok' AS outcome, [ts_ms] AS held FROM q WHERE rn = 1
  UNION ALL SELECT subject, request_id, ts_ms, rn, outcome, CASE WHEN outcome = 'ok' THEN list_append(held, ts_ms) ELSE held END FROM (
    SELECT *, CASE WHEN len(held) > 0 AND ts_ms - held[-1] < 3600000 THEN 'too-fast' WHEN len(held) >= 3 THEN 'rate-limited' ELSE 'ok' END AS outcome FROM (
      SELECT q.subject, q.request_id, q.ts_ms, q.rn, list_filter(g.held, lambda x: q.ts_ms - x <= 43200000) AS held
      FROM g JOIN q ON q.subject = g.subject AND q.rn = g.rn + 1)))
SELECT subject, request_id, ts_ms, outcome FROM g"""


@query("t9_admission", GATED)
def admitted(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("request_id")
    )
    hour = 3_600_000
    return admission.admission_decisions(requests, window_ms=12 * hour, max_per_window=3, min_gap_ms=hour)

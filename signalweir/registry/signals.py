"""Queries over signals: triage, calibration, incident lifecycle."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from signalweir.functions import signals as S
from signalweir.operators import calibration, lifecycle, merge, triage
from signalweir.registry.base import duck_stamp, query, rounded, stamp
from signalweir.registry.views import view, with_views
from signalweir.sources.alerts import normalize_signals, split_payloads

AS_OF = "2024-02-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def triaged(spark, sf_dir):
    return triage.triage(view(spark, sf_dir, "v_signals"))


def escalated(spark, sf_dir):
    return triage.split_decisions(triaged(spark, sf_dir))[0]


def escalated_keys(spark, sf_dir):
    """Only what the lifecycle scans order by: the settled slices stay narrow."""
    return escalated(spark, sf_dir).select("tenant_id", "fingerprint", "signal_id", "created_at")


@query(
    "a1_suppression_summary",
    with_views(
        ["v_decided"],
        """SELECT tenant_id, count(*) AS total, count(*) FILTER (WHERE score > 1.0/21.0) AS escalated,
  CAST(0 AS BIGINT) AS labeled, round(1.0/21.0, 6) AS threshold,
  count(*) FILTER (WHERE score <= 1.0/21.0) AS suppressed,
  round(count(*) FILTER (WHERE score <= 1.0/21.0) / count(*), 6) AS suppression_rate
FROM v_decided GROUP BY tenant_id""",
    ),
)
def suppression_summary(spark, sf_dir):
    return rounded(triage.suppression_summary(triaged(spark, sf_dir)), "threshold", "suppression_rate")


@query(
    "t1_triage",
    with_views(
        ["v_decided"],
        """SELECT signal_id, tenant_id, norm_entity, sev AS severity_value, CAST(kw AS INT) AS keywords, resolved, breach,
  round(score, 6) AS score, score > 1.0/21.0 AS escalated, fingerprint,
  substr(trim(concat(title, ' ', message)), 1, 500) AS excerpt
FROM v_decided""",
    ),
)
def triage_all(spark, sf_dir):
    out = triaged(spark, sf_dir).withColumn("norm_entity", S.normalize_entity(F.col("entity")))
    return rounded(out, "score").select(
        "signal_id", "tenant_id", "norm_entity", "severity_value", "keywords", "resolved", "breach",
        "score", "escalated", "fingerprint", "excerpt",
    )


@query(
    "f9_triage_with_tenant_costs",
    with_views(
        ["v_decided"],
        """SELECT tenant_id, round(any_value(cost), 6) AS threshold, count(*) FILTER (WHERE score > cost) AS escalated FROM (
  SELECT *, CASE tenant_id WHEN 't0' THEN 1.0/6.0 ELSE 1.0/21.0 END AS cost FROM v_decided) GROUP BY tenant_id""",
    ),
)
def triage_with_costs(spark, sf_dir):
    costs = spark.createDataFrame([("t0", 1.0, 5.0)], "tenant_id string, false_positive double, false_negative double")
    out = triage.triage(view(spark, sf_dir, "v_signals"), costs).groupBy("tenant_id").agg(
        F.max("threshold").alias("threshold"), F.count_if("escalated").alias("escalated")
    )
    return rounded(out, "threshold")


@query(
    "t2_split_decisions",
    with_views(
        ["v_decided"],
        """SELECT 'escalated' AS decision, tenant_id, count(*) AS n, round(min(score), 6) AS lowest, round(max(score), 6) AS highest
FROM v_decided WHERE score > 1.0/21.0 GROUP BY tenant_id
UNION ALL SELECT 'suppressed', tenant_id, count(*), round(min(score), 6), round(max(score), 6)
FROM v_decided WHERE score <= 1.0/21.0 GROUP BY tenant_id""",
    ),
)
def split_decisions(spark, sf_dir):
    yes, no = triage.split_decisions(triaged(spark, sf_dir))

    def digest(df, name):
        return df.groupBy("tenant_id").agg(
            F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest")
        ).select(F.lit(name).alias("decision"), "*")

    return rounded(digest(yes, "escalated").unionByName(digest(no, "suppressed")), "lowest", "highest")


@query(
    "o2_newest_suppressed_signals",
    with_views(
        ["v_decided"],
        f"""SELECT signal_id, norm_entity, round(score, 6) AS score, {duck_stamp("created_at")} AS created_at
FROM v_decided WHERE tenant_id = 't1' AND score <= 1.0/21.0 ORDER BY v_decided.created_at DESC, signal_id DESC LIMIT 50""",
    ),
)
def newest_suppressed(spark, sf_dir):
    rows = triage.list_signals(triaged(spark, sf_dir), "t1", "suppressed")
    return rounded(rows, "score").select(
        "signal_id", S.normalize_entity(F.col("entity")).alias("norm_entity"), "score",
        stamp("created_at").alias("created_at"),
    )


# four shapes: an alert list; labels around it and a breach as text; tags as a list; tags as an object
_PAYLOAD = """SELECT signal_id, tenant_id, created_at, CASE signal_id % 4
  WHEN 0 THEN to_json(named_struct(
    'alerts', array(named_struct('status', state, 'labels', map('service', entity, 'severity', severity, 'alertname', title),
      'annotations', map('description', message))),
    'breachedThreshold', breached))
  WHEN 1 THEN to_json(named_struct('status', state, 'labels', map('service', 'not this', 'resource', 'nor this', 'severity', severity),
    'alerts', array(named_struct('labels', map('service', entity))), 'annotations', map('summary', title, 'description', message),
    'threshold_breached', CASE WHEN breached THEN 'yes' ELSE '' END))
  WHEN 2 THEN to_json(named_struct('tags', array('env:prod', 'service:not this', 'alone', concat('service:', entity)), 'host', 'not this', 'alert_type', severity,
    'title', title, 'body', message, 'alert_transition', state, 'breachedThreshold', CAST(breached AS INT)))
  WHEN 3 THEN to_json(named_struct('source', 'tagger', 'tags', map('host', entity), 'priority', severity, 'alertname', title, 'message', message, 'state', state,
    'annotations', CASE WHEN breached THEN map('threshold', '80') ELSE map('other', '80') END)) END AS body FROM {signals}"""


@query(
    "s4_alert_payloads",
    with_views(
        ["v_decided"],
        """SELECT signal_id, tenant_id, CASE signal_id % 4 WHEN 2 THEN 'generic' WHEN 3 THEN 'tagger' ELSE 'grafana' END AS source, entity, severity, title, message, state,
  breached, round(score, 6) AS score FROM v_decided""",
    ),
)
def alert_payloads(spark, sf_dir):
    bodies = spark.sql(_PAYLOAD, signals=view(spark, sf_dir, "v_signals"))
    accepted, _ = split_payloads(bodies)
    scored = triage.triage(normalize_signals(accepted))
    return rounded(scored, "score").select(
        "signal_id", "tenant_id", "source", "entity", "severity", "title", "message", "state", "breached", "score"
    )


@query(
    "s4_rejected_payloads",
    with_views(
        ["v_signals"],
        """SELECT signal_id, 'invalid-json' AS reject_reason FROM v_signals WHERE signal_id % 19 = 0""",
    ),
)
def rejected_payloads(spark, sf_dir):
    bodies = spark.sql(_PAYLOAD, signals=view(spark, sf_dir, "v_signals"))
    torn = F.when(F.col("signal_id") % 19 == 0, F.expr("substr(body, 1, length(body) - 3)")).otherwise(F.col("body"))
    _, rejected = split_payloads(bodies.withColumn("body", torn))
    return rejected.select("signal_id", "reject_reason")


@query(
    "m5_apply_labels",
    with_views(
        ["v_decided"],
        """log AS (SELECT tenant_id, signal_id, CASE WHEN signal_id % 2 = 0 THEN 'noise' ELSE 'incident' END AS label, 1 AS at FROM v_decided
  UNION ALL SELECT tenant_id, signal_id, CASE WHEN breached THEN 'incident' ELSE 'noise' END, 2 FROM v_decided WHERE state = 'firing'
  UNION ALL SELECT 't9', signal_id, 'incident', 3 FROM v_decided)
SELECT d.tenant_id, d.signal_id, arg_max(l.label, l.at) AS label FROM v_decided d
  JOIN log l ON l.tenant_id = d.tenant_id AND l.signal_id = d.signal_id GROUP BY 1, 2""",
    ),
)
def apply_labels(spark, sf_dir):
    rows = triaged(spark, sf_dir)
    base = rows.select("tenant_id", "signal_id", "breached", "state")
    parity = F.when(F.col("signal_id") % 2 == 0, F.lit("noise")).otherwise(F.lit("incident"))
    firing = F.when(F.col("breached"), F.lit("incident")).otherwise(F.lit("noise"))
    log = (
        base.select("tenant_id", "signal_id", parity.alias("label"), F.lit(1).alias("labeled_at"))
        .unionByName(
            base.where("state = 'firing'").select(
                "tenant_id", "signal_id", firing.alias("label"), F.lit(2).alias("labeled_at")
            )
        )
        .unionByName(
            base.select(
                F.lit("t9").alias("tenant_id"), "signal_id", F.lit("incident").alias("label"), F.lit(3).alias("labeled_at")
            )
        )
    )
    return triage.apply_labels(rows, log).select("tenant_id", "signal_id", "label")


# --- calibration ---

_COUNTS = """count(*) FILTER (WHERE label = 'incident') AS pos, count(*) FILTER (WHERE label = 'noise') AS neg"""
_ROC = f"""per AS (SELECT tenant_id, score, {_COUNTS} FROM v_labeled GROUP BY 1, 2),
cand AS (SELECT tenant_id, score, sum(pos) AS pos, sum(neg) AS neg FROM (
  SELECT * FROM per UNION ALL SELECT DISTINCT tenant_id, CAST(0 AS DOUBLE), 0, 0 FROM per) GROUP BY 1, 2),
scan AS (SELECT tenant_id, score AS threshold,
  CAST(coalesce(sum(pos) OVER (PARTITION BY tenant_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(neg) OVER (PARTITION BY tenant_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY tenant_id) AS BIGINT) AS positives, CAST(sum(neg) OVER (PARTITION BY tenant_id) AS BIGINT) AS negatives FROM cand),
roc AS (SELECT *, positives - tp AS fn, negatives - fp AS tn,
  CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS tpr, CASE WHEN negatives > 0 THEN fp / negatives ELSE 0 END AS fpr,
  positives / (positives + negatives) AS prior FROM scan),
costed AS (SELECT *, (1 - prior) * fpr + 20.0 * prior * (1 - tpr) AS expected_cost FROM roc)"""


@query(
    "a3_confusion_matrix",
    with_views(
        ["v_labeled"],
        """m AS (SELECT tenant_id, count(*) FILTER (WHERE score > 0.3 AND label = 'incident') AS tp,
  count(*) FILTER (WHERE score > 0.3 AND label = 'noise') AS fp,
  count(*) FILTER (WHERE score <= 0.3 AND label = 'incident') AS fn,
  count(*) FILTER (WHERE score <= 0.3 AND label = 'noise') AS tn FROM v_labeled GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS tpr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr,
  (tp + fn) / (tp + fp + fn + tn) AS prior FROM m)
SELECT tenant_id, tp, fp, fn, tn, CAST(0.3 AS DOUBLE) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(prior, 6) AS prior,
  round((1 - prior) * fpr + 20 * prior * (1 - tpr), 6) AS expected_cost,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, fn AS missed_incidents FROM r""",
    ),
)
def confusion_matrix(spark, sf_dir):
    out = calibration.evaluate_threshold(view(spark, sf_dir, "v_labeled"), 0.3)
    return rounded(out, "tpr", "fpr", "prior", "expected_cost", "precision")


@query(
    "w6_roc_points",
    with_views(
        ["v_labeled"],
        _ROC
        + """, pick AS (SELECT * FROM costed) SELECT tenant_id, threshold, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
  round(prior, 6) AS prior, positives, negatives, round(expected_cost, 6) AS expected_cost FROM pick""",
    ),
)
def roc_points(spark, sf_dir):
    return rounded(calibration.roc_points(view(spark, sf_dir, "v_labeled")), "tpr", "fpr", "prior", "expected_cost")


@query(
    "a4_roc_sweep",
    with_views(
        ["v_labeled"],
        _ROC
        + """, best AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY round(expected_cost, 12), threshold) AS rn FROM costed)
SELECT tenant_id, threshold, round(expected_cost, 6) AS expected_cost, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
  round(prior, 6) AS prior, positives, negatives, positives + negatives AS sample_size FROM best WHERE rn = 1""",
    ),
)
def roc_sweep(spark, sf_dir):
    return rounded(
        calibration.sweep_threshold(view(spark, sf_dir, "v_labeled")), "expected_cost", "tpr", "fpr", "prior"
    )


@query(
    "a5_reliability_curve",
    with_views(
        ["v_labeled"],
        """b AS (SELECT tenant_id, least(floor(score * 10), 9) AS i, score, label FROM v_labeled)
SELECT tenant_id, concat(printf('%.1f', i / 10), '-', printf('%.1f', (i + 1) / 10)) AS bucket, count(*) AS n,
  round(avg(score), 6) AS mean_predicted, round(avg(CASE WHEN label = 'incident' THEN 1.0 ELSE 0.0 END), 6) AS observed_rate
FROM b GROUP BY tenant_id, i""",
    ),
)
def reliability(spark, sf_dir):
    return rounded(
        calibration.reliability_curve(view(spark, sf_dir, "v_labeled")), "mean_predicted", "observed_rate"
    )


@query(
    "a6_calibration_report",
    with_views(
        ["v_labeled"],
        _ROC
        + """, best AS (SELECT tenant_id, threshold, expected_cost, row_number() OVER (PARTITION BY tenant_id ORDER BY round(expected_cost, 12), threshold) AS rn FROM costed),
cur AS (SELECT tenant_id, count(*) AS labeled,
  count(*) FILTER (WHERE score > 1.0/21.0 AND label = 'incident') AS tp, count(*) FILTER (WHERE score > 1.0/21.0 AND label = 'noise') AS fp,
  count(*) FILTER (WHERE label = 'incident') AS p, count(*) FILTER (WHERE label = 'noise') AS n FROM v_labeled GROUP BY 1),
cc AS (SELECT *, (n / labeled) * (CASE WHEN n > 0 THEN fp / n ELSE 0 END) + 20 * (p / labeled) * (1 - CASE WHEN p > 0 THEN tp / p ELSE 0 END) AS cost FROM cur)
SELECT cc.tenant_id, CASE WHEN labeled >= 20 THEN 'ok' ELSE 'insufficient-labels' END AS status, labeled,
  round(1.0/21.0, 6) AS threshold_in_force, CASE WHEN labeled >= 20 THEN threshold END AS empirical_threshold,
  round(CASE WHEN labeled >= 20 THEN abs(threshold - 1.0/21.0) END, 6) AS divergence,
  round(CASE WHEN labeled >= 20 THEN cost - expected_cost END, 6) AS potential_cost_reduction
FROM cc JOIN best b ON b.tenant_id = cc.tenant_id AND rn = 1""",
    ),
)
def calibration_report(spark, sf_dir):
    out = calibration.calibration_report(view(spark, sf_dir, "v_labeled"))
    return rounded(out, "threshold_in_force", "divergence", "potential_cost_reduction")


# --- lifecycle ---

_ATTACH = """g AS (SELECT *, lag(created_at) OVER (PARTITION BY tenant_id, fingerprint ORDER BY created_at, signal_id) AS prev FROM v_escalated),
f AS (SELECT *, prev IS NULL OR created_at - prev >= INTERVAL 45 MINUTE AS opens,
  prev IS NOT NULL AND created_at - prev > INTERVAL 30 MINUTE AND created_at - prev < INTERVAL 45 MINUTE AS reopens FROM g),
n AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY tenant_id, fingerprint ORDER BY created_at, signal_id) AS incident_no FROM f),
a AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, fingerprint, incident_no ORDER BY created_at, signal_id) AS signal_no,
  sha256(concat(tenant_id, '|', fingerprint, '|', CAST(epoch_us(min(created_at) OVER (PARTITION BY tenant_id, fingerprint, incident_no)) AS VARCHAR))) AS incident_id FROM n)"""


SESSIONS = with_views(
    ["v_escalated"],
    _ATTACH
    + f""", s AS (SELECT incident_id, any_value(tenant_id) AS tenant_id, any_value(fingerprint) AS fingerprint, min(created_at) AS o, max(created_at) AS l,
  count(*) AS signal_count, count(*) FILTER (WHERE reopens) AS reopen_count FROM a GROUP BY incident_id)
SELECT incident_id, tenant_id, fingerprint, {duck_stamp("o")} AS opened_at, {duck_stamp("l")} AS last_seen_at, signal_count, reopen_count FROM s""",
)


@query("t6_incident_sessions", SESSIONS)
def sessions(spark, sf_dir):
    return lifecycle.incident_sessions(escalated(spark, sf_dir)).select(
        "incident_id", "tenant_id", "fingerprint", stamp("opened_at").alias("opened_at"),
        stamp("last_seen_at").alias("last_seen_at"), "signal_count", "reopen_count",
    )


@query(
    "a7_incident_rollup",
    with_views(
        ["v_escalated"],
        _ATTACH
        + f""", clock AS (SELECT max(created_at) + INTERVAL 1 MINUTE AS now FROM v_escalated),
s AS (SELECT incident_id, max(created_at) AS l, count(*) AS signal_count,
  arg_min(entity, signal_no) AS entity, arg_min(title, signal_no) AS t, arg_min(message, signal_no) AS description FROM a GROUP BY incident_id)
SELECT incident_id, entity, concat(entity, ': ', t) AS title, description, signal_count,
  CASE WHEN l < now - INTERVAL 30 MINUTE THEN 'resolved' ELSE 'open' END AS status,
  {duck_stamp("CASE WHEN l < now - INTERVAL 30 MINUTE THEN l + INTERVAL 30 MINUTE END")} AS resolved_at,
  CASE WHEN l < now - INTERVAL 30 MINUTE THEN 'auto-resolved: no signals for 30m' END AS resolution FROM s, clock""",
    ),
)
def rollup(spark, sf_dir):
    rows = escalated(spark, sf_dir)
    # a minute after the last signal, so that its incident is still open
    now = rows.agg(F.max("created_at")).first()[0] + timedelta(minutes=1)
    out = lifecycle.incident_rollup(rows, F.lit(now))
    return out.select(
        "incident_id", "entity", "title", "description", "signal_count", "status",
        stamp("resolved_at").alias("resolved_at"), "resolution",
    )


@query(
    "p5_stale_open_incidents",
    with_views(
        ["v_escalated"],
        _ATTACH
        + """, s AS (SELECT incident_id, max(created_at) AS l, count(*) AS signal_count FROM a GROUP BY incident_id)
SELECT incident_id, signal_count FROM s WHERE l < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 MINUTE""",
    ),
)
def stale_open(spark, sf_dir):
    sessions = lifecycle.incident_sessions(escalated(spark, sf_dir)).withColumn("status", F.lit("open"))
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return sessions.where(lifecycle.is_stale(as_of)).select("incident_id", "signal_count")


@query(
    "j13_signals_attached",
    with_views(
        ["v_escalated"],
        _ATTACH
        + """ SELECT signal_id, incident_id, signal_no, CASE WHEN opens THEN 'incident-opened' WHEN reopens THEN 'incident-reopened'
  ELSE 'signal-attached' END AS event_type FROM a""",
    ),
)
def attached(spark, sf_dir):
    return lifecycle.attach_signals(escalated_keys(spark, sf_dir)).select("signal_id", "incident_id", "signal_no", "event_type")


@query(
    "t7_analysis_triggers",
    with_views(
        ["v_escalated"],
        _ATTACH
        + f""" SELECT tenant_id, incident_id, signal_id, {duck_stamp("created_at")} AS triggered_at FROM a WHERE opens""",
    ),
)
def triggers(spark, sf_dir):
    out = lifecycle.analysis_triggers(lifecycle.attach_signals(escalated_keys(spark, sf_dir)))
    return out.withColumn("triggered_at", stamp("triggered_at"))


@query(
    "t8_lifecycle_events",
    with_views(
        ["v_escalated"],
        _ATTACH
        + f""", nx AS (SELECT *, lead(created_at) OVER (PARTITION BY tenant_id, fingerprint ORDER BY created_at, signal_id) AS nxt FROM a),
e AS (SELECT tenant_id, incident_id, CASE WHEN opens THEN 'incident-opened' WHEN reopens THEN 'incident-reopened' ELSE 'signal-attached' END AS event_type,
  created_at AS event_ts, signal_no, signal_id FROM a
UNION ALL SELECT tenant_id, incident_id, 'resolved', created_at + INTERVAL 30 MINUTE, signal_no, NULL FROM nx
  WHERE coalesce(nxt, TIMESTAMP '{AS_OF}') - created_at > INTERVAL 30 MINUTE)
SELECT tenant_id, incident_id, event_type, {duck_stamp("event_ts")} AS event_at, signal_no, signal_id FROM e""",
    ),
)
def events(spark, sf_dir):
    rows = escalated_keys(spark, sf_dir)
    out = lifecycle.lifecycle_events(lifecycle.attach_signals(rows), lifecycle.activity_blocks(rows), _as_of())
    return out.withColumn("event_at", stamp("event_at"))


@query(
    "o9_reopen_most_recent",
    with_views(
        ["v_escalated"],
        _ATTACH
        + """, s AS (SELECT tenant_id, fingerprint, incident_id, max(created_at) + INTERVAL 30 MINUTE AS r FROM a GROUP BY ALL)
SELECT v.signal_id, arg_max(s.incident_id, s.r) AS incident_id FROM v_escalated v
  JOIN s ON s.tenant_id = v.tenant_id AND s.fingerprint = v.fingerprint
    AND s.r > v.created_at + INTERVAL 35 MINUTE - INTERVAL 15 MINUTE AND s.r <= v.created_at + INTERVAL 35 MINUTE GROUP BY 1""",
    ),
)
def reopen_most_recent(spark, sf_dir):
    rows = escalated(spark, sf_dir)
    incidents = lifecycle.incident_rollup(rows, _as_of())
    later = rows.withColumn("created_at", F.expr("created_at + INTERVAL 35 MINUTES"))
    return lifecycle.reopen_candidates(incidents, later)


@query(
    "m1_upsert_incidents",
    with_views(
        ["v_escalated"],
        _ATTACH
        + """ SELECT incident_id, count(*) AS signal_count, CAST(sum(CAST(opens AS INT)) AS BIGINT) AS created,
  CAST(sum(CAST(reopens AS INT)) AS BIGINT) AS reopened FROM a GROUP BY incident_id""",
    ),
)
def upsert(spark, sf_dir):
    return merge.incident_counters(lifecycle.attach_signals(escalated_keys(spark, sf_dir)))

import datetime as dt
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from signalweir.functions import signals as S
from signalweir.operators import calibration, lifecycle, triage
from signalweir.sources.alerts import normalize_signals, split_payloads


def _sigma(z):
    return 1 / (1 + math.exp(-z))


def _normalize(spark, *bodies):
    texts = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return normalize_signals(spark.createDataFrame(texts, "n int, body string")).orderBy("n").collect()


def test_batch_alert_shape(spark):
    body = {
        "alerts": [
            {
                "status": "firing",
                "labels": {"alertname": "HighErrorRate", "service": "checkout", "severity": "critical"},
                "annotations": {"description": "5xx rate 41%"},
            }
        ]
    }
    (r,) = _normalize(spark, body)
    assert (r.source, r.entity, r.severity, r.state) == ("grafana", "checkout", "critical", "firing")
    assert (r.title, r.message) == ("HighErrorRate", "5xx rate 41%")


def test_tags_and_aliases(spark):
    a, b, c = _normalize(
        spark,
        {"tags": ["service:payments", "env:prod", "service:pay:v2", "junk"], "alert_type": "error"},
        {"tags": {"host": "h1"}, "priority": "p2", "body": "text"},
        {"labels": {"service": "outer", "job": "j"}, "alerts": [{"labels": {"service": ""}}]},
    )
    assert (a.entity, a.severity) == ("pay:v2", "error")
    assert (b.entity, b.severity, b.message) == ("h1", "p2", "text")
    assert c.entity == "j"  # the alert's empty label hides the outer one


@pytest.mark.parametrize("status", ["resolved", "ok", "Recovery", "SUCCESS"])
def test_all_clear(spark, status):
    assert _normalize(spark, {"status": status})[0].state == "resolved"


def test_junk_bodies(spark):
    for r in _normalize(spark, {}, "null", "[]", ""):
        assert (r.entity, r.severity, r.source, r.breached) == ("unknown", "warning", "generic", False)


def test_breach_truthiness(spark):
    bodies = [
        {"breachedThreshold": True}, {"breachedThreshold": False}, {"breachedThreshold": "false"}, {"threshold_breached": 0},
        {"annotations": {"threshold": "90%"}}, {"breachedThreshold": "", "threshold_breached": 1},
    ]
    assert [r.breached for r in _normalize(spark, *bodies)] == [True, False, True, False, True, True]


def test_rejects(spark):
    rows = [(1, "{}"), (2, "{bad"), (3, json.dumps({"x": "y" * 1_100_000}))]
    ok, bad = split_payloads(spark.createDataFrame(rows, "n int, body string"))
    assert [r.n for r in ok.collect()] == [1]
    assert {r.n: r.reject_reason for r in bad.collect()} == {2: "invalid-json", 3: "too-large"}


def _signal(**kw):
    base = dict(signal_id=1, tenant_id="t", source="s", entity="e", severity="warning", title="", message="",
                state="firing", breached=False, created_at=dt.datetime(2024, 1, 1))
    return Row(**{**base, **kw})


def test_a_made_body_is_made_once(spark):
    rows = spark.range(100).select(F.col("id").alias("signal_id"), F.to_json(F.struct(F.col("id").cast("string").alias("service"))).alias("body"))
    accepted, rejected = split_payloads(rows)
    for out in (normalize_signals(accepted), rejected):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("invoke(StructsToJson") == 1
        assert plan.count("from_json") <= 3  # the body, its tags as a list and as an object
    assert normalize_signals(accepted).count() == 100 and rejected.count() == 0


def test_scores(spark):
    cases = [
        (_signal(), -2.4, True),
        (_signal(severity="info"), -4.0, False),
        (_signal(severity="info", title="request timeout"), -2.8, True),
        (_signal(severity="critical", state="resolved"), -6.0, False),
        (_signal(severity="critical", state="resolved", title="timeout panic oom deadlock"), -2.4, True),
        (_signal(severity="weird", breached=True), -1.4, True),
    ]
    df = triage.triage(spark.createDataFrame([Row(**{**c[0].asDict(), "signal_id": i}) for i, c in enumerate(cases)]))
    for row, (_, z, escalated) in zip(df.orderBy("signal_id").collect(), cases):
        assert row.score == pytest.approx(_sigma(z)) and row.escalated is escalated


@pytest.mark.parametrize(
    "raw, name",
    [("Auth-Service ", "auth-service"), ("auth-7d9f", "auth"), ("auth_12", "auth"), ("checkout api", "checkout-api"), (None, "unknown")],
)
def test_entity(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "e string")
    assert df.select(S.normalize_entity(F.col("e"))).first()[0] == name


def test_same_problem_same_fingerprint(spark):
    df = spark.createDataFrame([("t", "auth-7d9f"), ("t", "auth-2b1c"), ("u", "auth")], "t string, e string")
    a, b, c = (r[0] for r in df.select(S.fingerprint(F.col("t"), F.col("e"))).collect())
    assert a == b != c


# --- calibration ---


def _labeled(spark, incidents, noise):
    rows = [("t", float(s), "incident") for s in incidents] + [("t", float(s), "noise") for s in noise] + [("t", 0.5, None)]
    return spark.createDataFrame(rows, "tenant_id string, score double, label string")


def test_separable(spark):
    best = calibration.sweep_threshold(_labeled(spark, [0.9, 0.8, 0.7], [0.2, 0.1, 0.05])).first()
    assert (best.tpr, best.fpr, best.expected_cost) == (1.0, 0.0, 0.0) and 0.2 <= best.threshold < 0.7


def test_asymmetric_cost_lowers_threshold(spark):
    rows = _labeled(spark, [0.30], [0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.35])
    careful = calibration.sweep_threshold(rows, 1, 100).first()
    even = calibration.sweep_threshold(rows, 1, 1).first()
    assert careful.threshold < even.threshold and careful.tpr == 1.0


def test_calibrated_sample(spark):
    rows = []
    for score in (0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6):
        hits = round(1000 * score)
        rows += [("t", score, "incident")] * hits + [("t", score, "noise")] * (1000 - hits)
    best = calibration.sweep_threshold(spark.createDataFrame(rows, "tenant_id string, score double, label string")).first()
    assert 0.03 <= best.threshold < 0.05


def test_boundary_escalates(spark):
    best = calibration.sweep_threshold(_labeled(spark, [0.5, 0.5], [0.1])).first()
    assert best.tp == 2 and best.threshold < 0.5


def test_sweep_equals_brute_force(spark):
    rows = [(f"t{i % 3}", ((i * 37) % 101) / 100, "incident" if (i * 13) % 7 < 2 else "noise") for i in range(900)]
    got = {
        r.tenant_id: r
        for r in calibration.sweep_threshold(spark.createDataFrame(rows, "tenant_id string, score double, label string")).collect()
    }
    for tenant in ("t0", "t1", "t2"):
        own = [(s, y) for t, s, y in rows if t == tenant]
        pos = sum(y == "incident" for _, y in own)
        neg, pi = len(own) - pos, pos / len(own)
        best = None
        for tau in [0.0, *sorted({s for s, _ in own})]:
            tp = sum(s > tau and y == "incident" for s, y in own)
            fp = sum(s > tau and y == "noise" for s, y in own)
            cost = (1 - pi) * fp / neg + 20 * pi * (1 - tp / pos)
            if best is None or cost < best[0]:
                best = (cost, tau)
        assert got[tenant].threshold == best[1] and got[tenant].expected_cost == pytest.approx(best[0])


def test_few_labels(spark):
    row = calibration.calibration_report(_labeled(spark, [0.9], [0.1])).first()
    assert row.status == "insufficient-labels" and row.empirical_threshold is None


# --- lifecycle ---

T0 = dt.datetime(2024, 1, 1, 12)


def _at(spark, *minutes, tenant="t", entity="auth"):
    rows = [
        _signal(signal_id=i, tenant_id=tenant, entity=entity, title=f"alert {i}", created_at=T0 + dt.timedelta(minutes=m))
        for i, m in enumerate(minutes)
    ]
    df = spark.createDataFrame(rows).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return df.withColumn("fingerprint", S.fingerprint(F.col("tenant_id"), F.col("entity")))


def _kinds(df):
    return [r.event_type for r in lifecycle.attach_signals(df).orderBy("signal_id").collect()]


def test_attach_reopen_and_recur(spark):
    assert _kinds(_at(spark, 0, 10, 40, 71, 116)) == [
        "incident-opened", "signal-attached", "signal-attached", "incident-reopened", "incident-opened"
    ]


def test_silence_is_strict_and_cooldown_is_not(spark):
    assert _kinds(_at(spark, 0, 30, 60.01, 105.01)) == [
        "incident-opened", "signal-attached", "incident-reopened", "incident-opened"
    ]


def test_flapping_is_one_incident_one_analysis(spark):
    attached = lifecycle.attach_signals(_at(spark, 0, 35, 70, 105, 140))
    assert lifecycle.analysis_triggers(attached).count() == 1
    (row,) = lifecycle.incident_sessions(_at(spark, 0, 35, 70, 105, 140)).collect()
    assert (row.signal_count, row.reopen_count) == (5, 4)


def test_tenants_stay_apart(spark):
    both = _at(spark, 0, 1).unionByName(_at(spark, 0, 1, tenant="u"))
    assert lifecycle.incident_sessions(both).count() == 2


def test_hand_opened_incidents_stay_and_sweep_is_idempotent(spark):
    rows = lifecycle.incident_rollup(_at(spark, 0, 5), F.lit("2024-01-01 12:20:00").cast("timestamp"))
    manual = rows.withColumn("fingerprint", F.lit(None).cast("string")).withColumn("incident_id", F.lit("m"))
    both = rows.unionByName(manual)
    later = F.lit("2024-01-01 13:00:00").cast("timestamp")
    once = lifecycle.resolve_stale(both, later)
    status = {r.incident_id: r.status for r in once.collect()}
    assert status.pop("m") == "open" and set(status.values()) == {"resolved"}
    assert once.exceptAll(lifecycle.resolve_stale(once, later)).count() == 0
    assert once.where("incident_id <> 'm'").first().resolution == "auto-resolved: no signals for 30m"


def test_sessions_equal_attached_signals_on_a_hot_key(spark):
    minutes = sorted(((i * 7919) % 20000) / 3 for i in range(1500))
    df = _at(spark, *minutes)
    by_blocks = {(r.incident_id, r.signal_count, r.reopen_count) for r in lifecycle.incident_sessions(df).collect()}
    per = lifecycle.attach_signals(df).groupBy("incident_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "incident-reopened").alias("r")
    )
    assert by_blocks == {(r.incident_id, r.n, r.r) for r in per.collect()}


def test_newest_resolved_is_reopened(spark):
    incidents = spark.createDataFrame(
        [("t", "f", "old", "resolved", T0), ("t", "f", "new", "resolved", T0 + dt.timedelta(minutes=5)), ("t", "f", "open", "open", None)],
        "tenant_id string, fingerprint string, incident_id string, status string, resolved_at timestamp",
    )
    signals = spark.createDataFrame(
        [("t", "f", 1, T0 + dt.timedelta(minutes=10)), ("t", "f", 2, T0 + dt.timedelta(minutes=20))],
        "tenant_id string, fingerprint string, signal_id long, created_at timestamp",
    )
    got = {r.signal_id: r.incident_id for r in lifecycle.reopen_candidates(incidents, signals).collect()}
    assert got == {1: "new"}

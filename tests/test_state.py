import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalweir.operators import admission, lifecycle, merge, reporting
from signalweir.operators.admission import Gate
from signalweir.sources import sinks
from signalweir.streaming.admission import stream_admission
from signalweir.streaming.incidents import stream_incidents

T0 = dt.datetime(2024, 1, 1, 12)


# --- fencing ---


def _writes(spark, *rows):
    return spark.createDataFrame([("r", t, n, a, b) for n, (t, a, b) in enumerate(rows)], "report_id string, token long, arrival long, status string, tier string")


def test_fenced_writes(spark):
    writes = _writes(spark, (1, "x", None), (1, None, "low"), (3, "y", None), (2, "stale", "stale"), (3, None, "high"), (None, "free", None), (2, "late", None))
    ok = [r.accepted for r in merge.accepted_writes(writes).orderBy("arrival").collect()]
    assert ok == [True, True, True, False, True, True, False]
    row = merge.fenced_merge(writes, ["status", "tier"]).first()
    assert (row.fence_token, row.status, row.tier, row.accepted_writes) == (3, "free", "high", 5)


# --- admission ---


def _brute(rows, window, most, gap):
    out, gates = {}, {}
    for subject, ts, rid in sorted(rows):
        out[rid] = gates.setdefault(subject, Gate(window, most, gap)).ask(ts)
    return out


def test_gate_rules():
    gate = Gate(60_000, 2, 1500)
    assert [gate.ask(t) for t in (0, 100, 1500, 4000, 60_000, 60_001)] == ["ok", "too-fast", "ok", "rate-limited", "rate-limited", "ok"]


@pytest.mark.parametrize("window, most, gap", [(1000, 3, 40), (60_000, 15, 1500), (50, 1, 10)])
def test_admission_equals_one_by_one(spark, window, most, gap):
    rng = random.Random(window)
    rows = [("hot" if i % 3 else f"s{i % 11}", rng.randrange(40_000), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "subject string, ts_ms long, request_id long").repartition(6)
    got = {r.request_id: r.outcome for r in admission.admission_decisions(df, window, most, gap).collect()}
    assert got == _brute(rows, window, most, gap)


# --- merges ---


def test_dedupe_and_running_baseline_wraps(spark):
    rows = [(n, "t", 1, h, 9000, T0 + dt.timedelta(seconds=n)) for n, h in enumerate("abcdefgha")]
    df = spark.createDataFrame(rows, "payload_id long, tenant_id string, incident_id long, input_hash string, amount long, created_at timestamp")
    unique = merge.dedupe_payloads(df)
    assert unique.count() == 8
    got = merge.running_baseline(unique).orderBy("payload_id").collect()
    assert [r.baseline for r in got] == [(n + 1) * 9000 % 65536 for n in range(8)]
    assert [r.anomaly for r in got] == [False] + [True] * 6 + [False]


def test_insert_if_absent(spark):
    kinds = "k string, v int"
    new = merge.insert_if_absent(spark.createDataFrame([("a", 1)], kinds), spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], kinds), ["k"])
    assert [tuple(r) for r in new.collect()] == [("b", 3)]


def test_transcript_is_oldest_first(spark):
    chat = spark.createDataFrame([("i", n, f"m{n}") for n in range(5)] + [("j", 0, "only")], "incident_id string, turn long, content string")
    got = reporting.transcript(chat, 3).orderBy("incident_id", "position").collect()
    assert [(r.incident_id, r.content, r.position) for r in got] == [("i", "m2", 1), ("i", "m3", 2), ("i", "m4", 3), ("j", "only", 1)]


def test_prompt_blocks(spark):
    similar = spark.createDataFrame([("i", 2, 0.71, "b\n c", None, None), ("i", 1, 0.956, "a", "redis", "SEV1")], "incident_id string, rank long, similarity double, summary string, primary_component string, severity string")
    assert reporting.similar_block(similar).first().block == (
        "SIMILAR PAST INCIDENTS:\n- [96% similar] SEV1 redis — a\n- [71% similar] unknown component — b c\n" + reporting.RECALL_ADVICE
    )
    ctx = spark.createDataFrame([("t", "db", 4, "a", 1, T0), ("t", "db", 4, "b", 7, T0)], "tenant_id string, component string, total_incidents long, downstream string, occurrence_count long, last_seen_at timestamp")
    lines = reporting.context_block(ctx).first().block.split("\n")
    assert lines[0] == "FAILURE HISTORY (db):" and lines[3] == "  • b — failed 7x (last seen: 2024-01-01T12:00:00.000Z)"
    assert lines[5:] == [reporting.HISTORY_ADVICE]


def test_payload_defaults(spark):
    reports = spark.createDataFrame([(1, 9, "{}"), (2, 8, '{"confidenceMatrix":{"overallScore":91.5}}')], "incident_id long, report_id long, ai_payload string")
    (row,) = reporting.notification_outbox(reports).collect()
    assert row.report_id == 8 and "91.5/100 (auto-resolve)" in row.message and "No action available" in row.message
    empty = reporting.parse_payload(reports).where("report_id = 9").select(reporting.report_summary(F.col("payload")))
    assert empty.first()[0] == ""


# --- streams: the same events as in batch ---

SIGNALS = "tenant_id string, fingerprint string, signal_id long, created_at timestamp"


def _signals(spark, n=400):
    rng = random.Random(5)
    minutes = sorted(rng.random() * 3000 for _ in range(n))
    return [("t" if i % 3 else "u", "hot" if i % 4 else "cold", i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]


def _fed(spark, folder, rows, schema, batches):
    """The rows as files that a stream reads one by one, oldest first."""
    import time

    size = -(-len(rows) // batches)
    for n in range(batches):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 if n + 1 < batches else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(df, tmp_path):
    sinks.stream_to(df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rows = _signals(spark)
    stream = _fed(spark, str(tmp_path / "in"), rows, SIGNALS, 4)
    out = _drain(stream_incidents(stream), tmp_path).collect()
    batch = lifecycle.attach_signals(spark.createDataFrame(rows, SIGNALS)).collect()
    assert {(r.signal_id, r.incident_id, r.signal_no, r.event_type) for r in out if r.signal_id is not None} == {
        (r.signal_id, r.incident_id, r.signal_no, r.event_type) for r in batch
    }
    ends = [(r.incident_id, r.event_us) for r in out if r.event_type == "resolved"]
    assert len(ends) == len(set(ends))  # a timer and a late look at the gap never both resolve
    reopened = sum(r.event_type == "incident-reopened" for r in batch)
    opened = sum(r.event_type == "incident-opened" for r in batch)
    assert len(ends) >= reopened + opened - 4  # all but the last of each of the four keys


def test_admission_of_a_subject_that_never_pauses(spark):
    """One subject over every slice, and small ones before and after it."""
    rows = [("m", n, n * 7 + n % 3) for n in range(5000)] + [(f"{c}{k}", 10_000 + k * 50 + n, n * 11) for c in "az" for k in range(5) for n in range(40)]
    df = spark.createDataFrame(rows, "subject string, request_id long, ts_ms long")
    got = {r.request_id: r.outcome for r in admission.admission_decisions(df, 1000, 20, 5).collect()}
    gates, want = {}, {}
    for subject, request, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        want[request] = gates.setdefault(subject, Gate(1000, 20, 5)).ask(ts)
    assert got == want
    assert admission.admission_decisions(df.limit(0)).count() == 0


def test_stream_admission_keeps_state_between_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted([(f"s{i % 3}", rng.randrange(20_000), i) for i in range(600)], key=lambda r: r[1])
    schema = "subject string, ts_ms long, request_id long"
    stream = _fed(spark, str(tmp_path / "in"), rows, schema, 3)
    got = {r.request_id: r.outcome for r in _drain(stream_admission(stream, 1000, 3, 40), tmp_path).collect()}
    assert got == _brute(rows, 1000, 3, 40)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", True, T0), ("u", False, T0)], "tenant_id string, escalated boolean, created_at timestamp")
    table = str(tmp_path / "signals")
    sinks.append_rows(rows, table, "created_at")
    assert sinks.scan(spark, table, "t").count() == 1 and sinks.scan(spark, table).count() == 2
    write = sinks.split_sink(str(tmp_path / "esc"), str(tmp_path / "sup"))
    write(rows, 0)
    write(rows, 0)  # replayed
    write(rows, 1)
    assert spark.read.parquet(str(tmp_path / "esc")).count() == 2 and spark.read.parquet(str(tmp_path / "sup")).count() == 2

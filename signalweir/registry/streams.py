"""Streaming queries, run over what is available now and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalweir.registry import signals as batch
from signalweir.registry.base import query
from signalweir.registry.reporting import GATED
from signalweir.registry.views import _VIEWS, open_tables, table, view, with_views
from signalweir.session import settle, shared_folder
from signalweir.streaming import admission, incidents, ingest
from signalweir.sources.sinks import stream_to
from signalweir.operators import documents, lifecycle, merge, triage
from signalweir.registry.documents import _CHANGES
from signalweir.sources.tables import StoredTable
from signalweir.streaming import ledger


def _stream_table(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _signals(spark, sf_dir):
    """v_signals over the event stream."""
    open_tables(spark, sf_dir)
    return spark.sql(_VIEWS["v_signals"][0].replace("FROM events", "FROM {events}"), events=_stream_table(spark, sf_dir, "events"))


def _drained(spark, rows):
    """The rows of a stream, written to the shared folder until its input is used up."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream_to(rows, f"{place}/rows", f"{place}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def _rocks(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


@query(
    "t1_stream_decisions",
    with_views(["v_decided"], "SELECT signal_id, tenant_id, round(score, 6) AS score, score > 1.0/21.0 AS escalated, fingerprint FROM v_decided"),
)
def stream_decisions(spark, sf_dir):
    bodies = spark.sql(batch._PAYLOAD, signals=_signals(spark, sf_dir))
    decided, _ = ingest.stream_decisions(bodies)
    rows = decided.select("signal_id", "tenant_id", F.round("score", 6).alias("score"), "escalated", "fingerprint")
    return _drained(spark, rows)


@query(
    "t3_stream_incidents",
    with_views(
        ["v_escalated"],
        batch._ATTACH
        + """ SELECT signal_id, incident_id, signal_no, CASE WHEN opens THEN 'incident-opened' WHEN reopens THEN 'incident-reopened'
  ELSE 'signal-attached' END AS event_type FROM a""",
    ),
)
def stream_incidents(spark, sf_dir):
    _rocks(spark)
    escalated, _ = triage.split_decisions(triage.triage(_signals(spark, sf_dir)))
    out = _drained(spark, incidents.stream_incidents(escalated))
    return out.where("signal_id IS NOT NULL").select("signal_id", "incident_id", "signal_no", "event_type")


@query(
    "t5_stream_flap_resolutions",
    with_views(
        ["v_escalated"],
        batch._ATTACH
        + """, nx AS (SELECT *, lead(created_at) OVER (PARTITION BY tenant_id, fingerprint ORDER BY created_at, signal_id) AS nxt FROM a)
SELECT tenant_id, incident_id, signal_no, epoch_us(created_at) + 1800000000 AS event_us FROM nx
WHERE nxt - created_at > INTERVAL 30 MINUTE OR (nxt IS NULL AND created_at + INTERVAL 30 MINUTE < (SELECT max(created_at) FROM v_escalated) - INTERVAL 10 MINUTE)""",
    ),
)
def stream_resolutions(spark, sf_dir):
    """Resolutions seen by a later signal of the key, and those that only the timer finds, up to the watermark."""
    _rocks(spark)
    escalated, _ = triage.split_decisions(triage.triage(_signals(spark, sf_dir)))
    out = _drained(spark, incidents.stream_incidents(escalated))
    return out.where("event_type = 'resolved'").select("tenant_id", "incident_id", "signal_no", "event_us")


@query(
    "t10_stream_dedupe",
    with_views(["v_payloads"], "SELECT DISTINCT tenant_id, incident_id, sha256(body) AS input_hash FROM v_payloads"),
)
def stream_dedupe(spark, sf_dir):
    open_tables(spark, sf_dir)
    text = _VIEWS["v_payloads"][0].replace("FROM orders", "FROM {orders}")
    payloads = spark.sql(text, orders=_stream_table(spark, sf_dir, "orders"))
    rows = ingest.stream_dedupe(payloads, lateness="7 days")
    return _drained(spark, rows.select("tenant_id", "incident_id", "input_hash"))


@query("t9_stream_admission", GATED)
def stream_admission(spark, sf_dir):
    _rocks(spark)
    requests = _stream_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("event_id").alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")
    )
    hour = 3_600_000
    return _drained(spark, admission.stream_admission(requests, window_ms=12 * hour, max_per_window=3, min_gap_ms=hour))


# --- stored tables that batches are merged into, some of them twice ---


def _place(spark):
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query(
    "m1_stored_upsert",
    with_views(
        ["v_escalated"],
        batch._ATTACH
        + """ SELECT incident_id, count(*) AS signal_count, CAST(sum(CAST(opens AS INT)) AS BIGINT) AS created,
  CAST(sum(CAST(reopens AS INT)) AS BIGINT) AS reopened FROM a GROUP BY incident_id""",
    ),
)
def stored_upsert(spark, sf_dir):
    attached = settle(lifecycle.attach_signals(batch.escalated_keys(spark, sf_dir)).select("incident_id", "signal_id", "event_type"))
    stored = StoredTable(spark, _place(spark), "incident_id string, signal_count long, created long, reopened long", ["incident_id"])
    for n in (0, 1, 1, 2, 0):  # the second batch comes again, the first one late
        stored.merge(n, merge.incident_counters(attached.where(F.pmod("signal_id", F.lit(3)) == n)), merge.add_counters)
    return stored.read()


@query("t5_late_reconciled", batch.SESSIONS)
def late_reconciled(spark, sf_dir):
    """Signals in batches that know no order; one batch comes twice."""
    signals = settle(batch.escalated(spark, sf_dir).select("tenant_id", "fingerprint", "signal_id", "created_at"))
    stored, write = ledger.block_ledger(spark, _place(spark))
    for batch_id, part in ((0, 2), (1, 0), (1, 0), (2, 3), (3, 1)):
        write(signals.where(F.pmod(F.xxhash64("signal_id"), F.lit(4)) == part), batch_id)
    return ledger.reconciled_incidents(stored).select(
        "incident_id", "tenant_id", "fingerprint", batch.stamp("opened_at").alias("opened_at"),
        batch.stamp("last_seen_at").alias("last_seen_at"), "signal_count", "reopen_count",
    )


@query(
    "t11_stream_versions",
    with_views(
        ["v_docs"],
        _CHANGES
        + """ SELECT tenant_id, collection, source_uri, max(version) AS version, arg_max(content_hash, version) AS content_hash
FROM ch WHERE action <> 'unchanged' GROUP BY 1, 2, 3""",
    ),
)
def stream_versions(spark, sf_dir):
    """Newer versions come first, so most of what follows is stale."""
    keys = ["tenant_id", "collection", "source_uri"]
    changed = documents.document_changes(view(spark, sf_dir, "v_docs")).where("action <> 'unchanged'")
    rows = settle(changed.select(*keys, "version", "content_hash"))
    stored, write = ledger.version_ledger(spark, _place(spark), "tenant_id string, collection string, source_uri string, version long, content_hash string", keys)
    for batch_id, part in ((0, 2), (1, 1), (1, 1), (2, 0)):
        write(rows.where(F.pmod("version", F.lit(3)) == part), batch_id)
    return stored.read()

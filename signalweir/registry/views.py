"""Domain views over the benchmark tables, in Spark SQL and in DuckDB SQL.

Text is shared by the two dialects unless a second form is given.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from signalweir.session import configure

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_ENTITY = """CASE event_type WHEN 'click' THEN 'auth-service-7d9f' WHEN 'view' THEN 'Auth-Service'
    WHEN 'error' THEN 'payment_gateway' WHEN 'purchase' THEN 'checkout api' ELSE 'redis' END"""

# name -> (spark text, duckdb text, views it reads)
_VIEWS: dict[str, tuple[str, str | None, list[str]]] = {
    "v_signals": (
        f"""SELECT event_id AS signal_id, concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id, 'monitor' AS source,
  {_ENTITY} AS entity,
  CASE WHEN value > 120 THEN 'critical' WHEN value > 60 THEN 'error' WHEN value > 25 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN event_id % 7 = 0 THEN 'Connection timeout' WHEN event_id % 11 = 0 THEN 'OOM: pool exhausted'
    ELSE 'status update' END AS title,
  props AS message, CASE WHEN event_id % 13 = 0 THEN 'resolved' ELSE 'firing' END AS state,
  (value > 150) AS breached, CAST(ts AS TIMESTAMP) AS created_at FROM events""",
        None,
        [],
    ),
    # the triage decision in SQL, the base of the lifecycle oracles
    "v_decided": (
        "",
        """SELECT s.*, sha256(concat(tenant_id, chr(0), norm_entity)) AS fingerprint,
  1.0 / (1.0 + exp(-(-4.0 + 4.0 * sev + 1.2 * kw - 6.0 * resolved + 1.0 * breach))) AS score
FROM (SELECT *, regexp_replace(regexp_replace(trim(lower(entity)), '[-_](?:[0-9a-f]{4,10}|[0-9]+)$', ''), '\\s+', '-', 'g') AS norm_entity,
  CAST(CASE severity WHEN 'critical' THEN 1.0 WHEN 'error' THEN 0.8 WHEN 'warning' THEN 0.4 ELSE 0.0 END AS DOUBLE) AS sev,
  least(3, CAST(contains(lower(title), 'timeout') AS INT) + CAST(contains(lower(title), 'exhausted') AS INT)
    + CAST(contains(lower(title), 'oom') AS INT)) AS kw,
  CAST(state = 'resolved' AS INT) AS resolved, CAST(breached AS INT) AS breach FROM v_signals) s""",
        ["v_signals"],
    ),
    "v_escalated": ("", "SELECT * FROM v_decided WHERE score > 1.0 / 21.0", ["v_decided"]),
    "v_labeled": (
        """SELECT l.doc_id, d.source AS tenant_id,
  CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'incident' ELSE 'noise' END AS label,
  round(CAST(CASE WHEN l.quality = 0 THEN 0.35 ELSE 0.05 END AS DOUBLE)
        + CAST(d.n_chars % 97 AS DOUBLE) / CAST(200 AS DOUBLE), 3) AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
        None,
        [],
    ),
    "v_log_lines": (
        """SELECT concat('t', CAST(user_id % 2 AS STRING)) AS tenant_id, concat('inc', CAST(user_id % 40 AS STRING)) AS incident_id,
  concat('src', CAST(user_id % 4 AS STRING), '.log') AS source_file, event_id AS line_no,
  concat(CASE WHEN event_id % 17 = 0 THEN '' ELSE concat(substr(CAST(ts AS STRING),1,19), ' ') END,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'FATAL' ELSE 'INFO' END,
    ' user', CAST(user_id AS STRING), ' value=', CAST(CAST(floor(value) AS INT) AS STRING),
    ' token=', substr(concat('abcdef00', CAST(event_id % 50 AS STRING)),1,10)) AS raw
FROM events""",
        None,
        [],
    ),
    "v_named_lines": ("", "SELECT * REPLACE (concat(raw, ' via redis') AS raw) FROM v_log_lines", ["v_log_lines"]),
    "v_reports": (
        """SELECT o_orderkey AS report_id, o_custkey AS incident_id, concat('t', CAST(c_nationkey % 3 AS STRING)) AS tenant_id,
  o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) % 101 AS confidence, o_orderdate AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
        None,
        [],
    ),
    "v_incidents": (
        """SELECT c_custkey AS incident_id, concat('t', CAST(c_nationkey % 3 AS STRING)) AS tenant_id, c_name AS title,
  CASE WHEN c_custkey % 4 = 0 THEN 'resolved' WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'open' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('f', CAST(c_custkey AS STRING)) END AS fingerprint,
  CAST(CAST('2024-01-01' AS DATE) AS TIMESTAMP) AS created_at FROM customer""",
        None,
        [],
    ),
    "v_edges": (
        """SELECT concat('t', CAST(l_suppkey % 2 AS STRING)) AS tenant_id, CAST(l_partkey AS BIGINT) AS from_node,
  CAST((l_partkey * 7 + l_linenumber % 2) % (SELECT count(*) FROM part) AS BIGINT) AS to_node, count(*) AS occurrence_count,
  max(l_shipdate) AS last_seen_at
FROM lineitem GROUP BY 1, 2, 3""",
        None,
        [],
    ),
    "v_beliefs": (
        """SELECT l_suppkey AS incident_id, l_linestatus AS voter, l_returnflag AS hypothesis_id, sum(l_quantity) AS prior
FROM lineitem GROUP BY 1, 2, 3""",
        None,
        [],
    ),
    # seven raw hypotheses per incident: two restate others, some incidents lack a prior
    "v_raw_hypotheses": (
        """SELECT concat('i', CAST(l_suppkey AS STRING)) AS incident_id, concat('t', CAST(l_suppkey % 3 AS STRING)) AS tenant_id,
  CAST(l_linenumber AS BIGINT) AS position,
  concat(CASE WHEN l_linenumber > 5 THEN 'Cause  no-' ELSE 'cause no ' END, CAST((l_linenumber * 3) % 5 AS STRING)) AS hypothesis,
  CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 2 THEN NULL WHEN l_suppkey % 4 = 1 AND l_linenumber = 1 THEN CAST(sum(l_quantity) * 40 AS DOUBLE)
    ELSE CAST(sum(l_quantity) AS DOUBLE) END AS prior,
  CASE l_linenumber WHEN 1 THEN 'Auth-Service' WHEN 2 THEN 'payment' WHEN 3 THEN 'checkout-api (pool)' WHEN 4 THEN 'redis' END AS component
FROM lineitem GROUP BY l_suppkey, l_linenumber""",
        None,
        [],
    ),
    # four voters per incident
    "v_ballots": (
        """SELECT concat('i', CAST(l_suppkey AS STRING)) AS incident_id,
  CASE WHEN l_suppkey % 9 = 0 THEN 'alone' ELSE concat(l_linestatus, CAST(l_linenumber % 2 AS STRING)) END AS voter,
  l_returnflag AS hypothesis_id, CAST(sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) AS DOUBLE) AS prior
FROM lineitem GROUP BY 1, 2, 3""",
        None,
        [],
    ),
    # forty steps per report at every scale: the number of reports grows, not the report
    "v_steps": (
        """SELECT p_partkey AS step_id, CAST(floor(p_partkey / 40) AS BIGINT) AS report_id,
  CASE WHEN p_type LIKE 'E%' THEN 'diagnostic' ELSE 'mitigation' END AS step_type,
  p_size * 2 AS success_probability, p_size AS root_cause_probability, p_size * 2 AS decision_value,
  p_size * 3 AS recovery_minutes, 1 + p_size % 10 AS blast_radius,
  CASE p_partkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'impossible' END AS reversibility,
  CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS evidence_quality,
  CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM part""",
        None,
        [],
    ),
    "v_fence": (
        """SELECT l_orderkey AS report_id, CAST(l_linenumber AS BIGINT) AS token, l_returnflag AS status_value,
  CASE WHEN l_quantity > 25 THEN l_linestatus END AS tier_value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS arrival
FROM lineitem""",
        None,
        [],
    ),
    "v_chunks": (
        """SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, d.lang AS tenant_id, 'runbooks' AS collection,
  d.source AS title, d.text AS content, e.embedding
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
        None,
        [],
    ),
    # every benchmark passage is a question of one tenant, with a vector of the corpus
    "v_questions": (
        """SELECT b.item_id AS query_id, CASE b.item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS tenant_id,
  'runbooks' AS collection, b.text AS query_text, e.embedding
FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
        None,
        [],
    ),
    "v_docs": (
        """SELECT doc_id, lang AS tenant_id, concat('c', CAST(doc_id % 3 AS STRING)) AS collection, concat('doc', CAST(doc_id % 40 AS STRING), '.md') AS source_uri,
  CASE WHEN doc_id % 5 = 0 THEN 'the same notice' ELSE text END AS content, doc_id AS arrival FROM documents""",
        None,
        [],
    ),
    "v_chat": ("SELECT conv_id AS incident_id, turn, role, text AS content FROM conversations", None, []),
    "v_markdown": (
        """SELECT conv_id AS document_id, concat('# Conversation ', CAST(conv_id AS STRING), chr(10),
  listagg(concat(CASE WHEN turn % 3 = 0 THEN '## ' ELSE '### ' END, role, ' ', CAST(turn AS STRING), chr(10), text, chr(10)), chr(10))
    WITHIN GROUP (ORDER BY turn)) AS content FROM conversations GROUP BY conv_id""",
        """SELECT conv_id AS document_id, concat('# Conversation ', CAST(conv_id AS STRING), chr(10),
  string_agg(concat(CASE WHEN turn % 3 = 0 THEN '## ' ELSE '### ' END, role, ' ', CAST(turn AS STRING), chr(10), text, chr(10)), chr(10)
    ORDER BY turn)) AS content FROM conversations GROUP BY conv_id""",
        [],
    ),
    # one analysis result per event: named components, reasoning text, evidence text
    "v_findings": (
        f"""SELECT event_id AS report_id, concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id,
  {_ENTITY} AS primary_component,
  CASE event_id % 6 WHEN 0 THEN 'db-pooler' WHEN 1 THEN 'the upstream service' WHEN 2 THEN 'Billing_Worker'
    WHEN 3 THEN 'connection pool' WHEN 4 THEN 'kafka' ELSE 'search-indexer-02' END AS hypothesis_component,
  concat(CASE event_id % 5 WHEN 0 THEN 'postgres slow' WHEN 1 THEN 'orders-api timing out'
    WHEN 2 THEN 'ledger_db locked by redis' WHEN 3 THEN 'no change' ELSE 'Session-Cache evictions' END,
    ' for user', CAST(user_id AS STRING)) AS reasoning,
  concat('db-pooler billing worker kafka ', CASE WHEN event_id % 2 = 0 THEN 'postgres orders-api ' ELSE 'ledger-db redis ' END,
    props) AS evidence_text, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
        None,
        [],
    ),
    "v_payloads": (
        """SELECT o_orderkey AS payload_id, concat('t', CAST(c_nationkey % 3 AS STRING)) AS tenant_id, o_custkey AS incident_id,
  concat(o_orderpriority, o_orderstatus) AS body, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS amount,
  CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
        None,
        [],
    ),
}


def open_tables(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Register the tables that `sql` names (all without one) for this session."""
    configure(spark)
    for name in TABLES:
        if sql is None or re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _VIEWS[name][0]
    open_tables(spark, sf_dir, sql)
    return spark.sql(sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: list[str], sql: str) -> str:
    """A DuckDB query over the named views, as one WITH statement.

    `sql` may itself start with further CTEs: give them as "name AS (...), ... SELECT".
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _VIEWS[name][2]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n][1] or _VIEWS[n][0]})" for n in ordered)
    body = sql.strip()
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {ctes}{joiner}{body}"

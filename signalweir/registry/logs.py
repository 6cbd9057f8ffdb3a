"""Queries over log lines: scalars, retention, fusion, redaction, encryption."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalweir.functions import logs as L
from signalweir.functions.redaction import DETECTORS
from signalweir.operators import logs, redaction
from signalweir.registry.base import query
from signalweir.registry.views import table, view, with_views
from signalweir.session import settle, shared_folder
from signalweir.sources import files

# the prepared lines in SQL
_PREP = """prep AS (SELECT incident_id, source_file, line_no, raw, nullif(regexp_extract(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}'), '') AS stamp,
  CASE WHEN regexp_matches(raw, '\\b(FATAL|CRITICAL|EMERG|ALERT|PANIC|SEGFAULT)\\b') THEN 3 WHEN regexp_matches(raw, '\\b(ERROR|EXCEPTION)\\b') THEN 2
    WHEN regexp_matches(raw, '\\b(WARN|WARNING)\\b') THEN 1 ELSE 0 END AS severity,
  strlen(raw) AS bytes, regexp_replace(lower(raw), '\\s+', '', 'g') AS line_key FROM v_log_lines),
lines AS (SELECT *, coalesce(epoch_us(TRY_CAST(stamp AS TIMESTAMP)), 9223372036854775807) AS sort_key FROM prep)"""
_FUSE = (
    _PREP
    + """, fused AS (SELECT *, concat('[', source_file, '] ', coalesce(stamp, 'no-timestamp'), ' | ', raw) AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id, line_key ORDER BY sort_key, source_file, line_no) AS rn FROM lines) WHERE rn = 1),
placed AS (SELECT *, row_number() OVER w AS line_index,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY incident_id ORDER BY sort_key, source_file, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM fused WINDOW w AS (PARTITION BY incident_id ORDER BY sort_key, source_file, line_no))"""
)
_RETAIN = (
    _PREP
    + """, e AS (SELECT *, sum(bytes + 1) OVER w AS b, row_number() OVER w AS n FROM lines
    WINDOW w AS (PARTITION BY incident_id, source_file ORDER BY sort_key, line_no)),
s AS (SELECT *, sum(bytes + 1) OVER w AS b, row_number() OVER w AS n FROM lines WHERE severity > 0
    WINDOW w AS (PARTITION BY incident_id, source_file ORDER BY severity DESC, sort_key, line_no)),
both_kept AS (SELECT 0 AS bucket, 0 AS neg, * EXCLUDE (b, n) FROM e WHERE b <= 1600 AND n <= 200000
  UNION ALL SELECT 1, -severity, * EXCLUDE (b, n) FROM s WHERE b <= 2400 AND n <= 200000),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, source_file, line_key ORDER BY bucket, neg, sort_key, line_no) AS rn FROM both_kept) WHERE rn = 1)"""
)


def _lines(spark, sf_dir):
    return view(spark, sf_dir, "v_log_lines").drop("tenant_id")


def _prepared(spark, sf_dir):
    return logs.prepare_lines(_lines(spark, sf_dir))


@query(
    "f13_line_scalars",
    with_views(["v_log_lines"], _PREP + " SELECT line_no, stamp, sort_key, severity, bytes, line_key FROM lines"),
)
def line_scalars(spark, sf_dir):
    return _prepared(spark, sf_dir).select(
        "line_no", "stamp", "sort_key", "severity", "bytes", L.line_key(F.col("raw")).alias("line_key")
    )


@query(
    "s1_log_files",
    with_views(["v_log_lines"], "SELECT raw, CAST(count(*) + count(*) FILTER (WHERE line_no % 2 = 0) AS BIGINT) AS n FROM v_log_lines GROUP BY raw"),
)
def log_files(spark, sf_dir):
    """Lines written as plain and as gzip files, beside files that are not text, and read back."""
    place = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    lines = view(spark, sf_dir, "v_log_lines")
    lines.select("raw").write.text(f"{place}/plain")
    lines.where("line_no % 2 = 0").select("raw").write.option("compression", "gzip").text(f"{place}/zipped")
    lines.select(F.concat(F.lit("\x01\x02\x03\x04"), F.col("line_no").cast("string")).alias("raw")).write.text(f"{place}/binary")
    text, _ = files.quarantine_binary(files.read_log_lines(spark, [f"{place}/{k}" for k in ("plain", "zipped", "binary")]))
    return text.groupBy("raw").agg(F.count("*").alias("n"))


@query(
    "p17_severe_lines",
    with_views(["v_log_lines"], _PREP + " SELECT line_no, severity FROM lines WHERE severity > 0"),
)
def severe(spark, sf_dir):
    return logs.severe_lines(_prepared(spark, sf_dir)).select("line_no", "severity")


@query(
    "w1_retained_lines",
    with_views(["v_log_lines"], _RETAIN + " SELECT incident_id, source_file, line_no, raw, severity, bucket FROM kept"),
)
def retained(spark, sf_dir):
    kept = logs.retain_lines(_prepared(spark, sf_dir), max_bytes=4000)
    return kept.select("incident_id", "source_file", "line_no", "raw", "severity", "bucket")


@query(
    "w2_retained_text",
    with_views(
        ["v_log_lines"],
        _RETAIN
        + """ SELECT incident_id, source_file, string_agg(raw, chr(10) ORDER BY sort_key, bucket, neg, line_no) AS text
FROM kept GROUP BY 1, 2""",
    ),
)
def retained_text(spark, sf_dir):
    return logs.retained_text(logs.retain_lines(_prepared(spark, sf_dir), max_bytes=4000))


@query(
    "a14_retention_stats",
    with_views(
        ["v_log_lines"],
        _RETAIN
        + """, t AS (SELECT incident_id, source_file, count(*) AS total_lines, count(*) FILTER (WHERE severity > 0) AS severe_lines FROM lines GROUP BY 1, 2),
r AS (SELECT incident_id, source_file, CAST(sum(strlen(raw) + 3) AS BIGINT) AS total_bytes FROM v_log_lines GROUP BY 1, 2),
k AS (SELECT incident_id, source_file, count(*) AS retained_lines FROM kept GROUP BY 1, 2)
SELECT t.*, total_bytes, coalesce(retained_lines, 0) AS retained_lines, coalesce(retained_lines, 0) < total_lines AS truncated
FROM t JOIN r USING (incident_id, source_file) LEFT JOIN k USING (incident_id, source_file)""",
    ),
)
def retention_stats(spark, sf_dir):
    # two blanks at the end of each line: read, but no part of its text
    lines = _lines(spark, sf_dir).withColumn("raw", F.concat("raw", F.lit("  ")))
    prepared = logs.prepare_lines(lines)
    return logs.retention_stats(lines, prepared, logs.retain_lines(prepared, max_bytes=4000))


@query(
    "w3_fused_lines",
    with_views(["v_log_lines"], _FUSE + ' SELECT incident_id, line_index, "offset", line FROM placed'),
)
def fused_lines(spark, sf_dir):
    return logs.positions(logs.fuse_lines(_prepared(spark, sf_dir))).select(
        "incident_id", "line_index", "offset", "line"
    )


@query(
    "a18_fuse_stats",
    with_views(
        ["v_log_lines"],
        _FUSE
        + """ SELECT incident_id, count(*) AS line_count, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS chars,
  (SELECT count(DISTINCT source_file) + 1 FROM lines l WHERE l.incident_id = fused.incident_id) AS source_count FROM fused GROUP BY incident_id""",
    ),
)
def fuse_stats(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    # a further source per incident that holds nothing but a blank line
    blank = lines.select("incident_id").distinct().select(
        "incident_id", F.lit("blank.log").alias("source_file"), F.lit(-1).cast(lines.schema["line_no"].dataType).alias("line_no"), F.lit("  ").alias("raw")
    )
    lines = lines.unionByName(blank)
    prepared = logs.prepare_lines(lines)
    return logs.fuse_stats(lines, logs.fuse_lines(prepared))


@query(
    "a19_fused_head",
    with_views(
        ["v_log_lines"],
        _FUSE
        + """ SELECT incident_id, substr(string_agg(line, chr(10) ORDER BY line_index), 1, 3000) AS head FROM placed GROUP BY incident_id""",
    ),
)
def fused_head(spark, sf_dir):
    return logs.fused_head(logs.positions(logs.fuse_lines(_prepared(spark, sf_dir))), 3000)


@query(
    "d4_line_chunks",
    with_views(
        ["v_log_lines"],
        _FUSE.replace("placed AS (", "placed AS MATERIALIZED (")
        + """, c AS (SELECT incident_id, line_index, line, 0::BIGINT AS chunk_index, length(line) AS used FROM placed WHERE line_index = 1
  UNION ALL SELECT p.incident_id, p.line_index, p.line, c.chunk_index + CASE WHEN c.used + length(p.line) + 1 > 2000 THEN 1 ELSE 0 END,
    CASE WHEN c.used + length(p.line) + 1 > 2000 THEN length(p.line) ELSE c.used + length(p.line) + 1 END
  FROM c JOIN placed p ON p.incident_id = c.incident_id AND p.line_index = c.line_index + 1)
SELECT incident_id, chunk_index, string_agg(line, chr(10) ORDER BY line_index) AS content FROM c WHERE chunk_index < 12 GROUP BY 1, 2""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def line_chunks(spark, sf_dir):
    placed = logs.positions(logs.fuse_lines(_prepared(spark, sf_dir)))
    return logs.line_chunks(placed, max_chars=2000)


@query(
    "f17_hard_split",
    with_views(
        ["v_log_lines"],
        """parts AS (SELECT line_no, unnest(range(greatest(1, CAST(ceil(length(raw) / 25) AS BIGINT)))) AS piece, raw FROM v_log_lines)
SELECT line_no, CAST(piece AS INT) AS piece, substr(raw, piece * 25 + 1, 25) AS raw FROM parts""",
    ),
)
def hard_split(spark, sf_dir):
    return logs.hard_split(_lines(spark, sf_dir), 25).select("line_no", "piece", "raw")


@query(
    "a2_evidence_counts",
    with_views(
        ["v_log_lines"],
        """SELECT incident_id, count(*) AS evidence_rows FROM (SELECT DISTINCT incident_id, source_file FROM v_log_lines) GROUP BY 1""",
    ),
)
def evidence_counts(spark, sf_dir):
    return logs.evidence_counts(_lines(spark, sf_dir).select("incident_id", "source_file").distinct())


# --- redaction ---

_SECRET = "token=([A-Za-z0-9_./+=-]{8,})"
_TOKENS = f"""hit AS (SELECT incident_id, line_no, raw, regexp_extract(raw, '{_SECRET}', 1) AS value FROM v_log_lines),
firsts AS (SELECT incident_id, value, min(line_no) AS at_line FROM hit WHERE value <> '' GROUP BY 1, 2),
map AS (SELECT incident_id, value, concat('«SECRET_', CAST(row_number() OVER (PARTITION BY incident_id ORDER BY at_line) AS VARCHAR), '»') AS placeholder FROM firsts)"""


def _texts(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "incident_id", F.col("line_no").alias("text_id"), F.col("line_no").alias("text_seq"), F.col("raw").alias("text")
    )


def _redacted(spark, sf_dir):
    detected = settle(redaction.detect_sensitive(_texts(spark, sf_dir)))
    mapping = redaction.number_placeholders(redaction.sensitive_hits(detected))
    return detected, mapping


@query(
    "r3_placeholder_map",
    with_views(["v_log_lines"], _TOKENS + " SELECT incident_id, placeholder, 'SECRET' AS type, value FROM map"),
)
def placeholder_map(spark, sf_dir):
    return _redacted(spark, sf_dir)[1].drop("token")


@query(
    "r3_redacted_lines",
    with_views(
        ["v_log_lines"],
        _TOKENS
        + """ SELECT h.line_no AS text_id, CASE WHEN m.placeholder IS NULL THEN raw ELSE replace(raw, 'token=' || h.value, 'token=' || m.placeholder) END AS redacted
FROM hit h LEFT JOIN map m ON m.incident_id = h.incident_id AND m.value = h.value""",
    ),
)
def redacted_lines(spark, sf_dir):
    detected, mapping = _redacted(spark, sf_dir)
    return redaction.redact(detected, mapping).select("text_id", "redacted")


@query(
    "r4_new_mappings",
    with_views(
        ["v_log_lines"],
        _TOKENS + " SELECT incident_id, placeholder, value FROM map WHERE placeholder NOT IN ('«SECRET_1»', '«SECRET_2»')",
    ),
)
def new_mappings(spark, sf_dir):
    mapping = _redacted(spark, sf_dir)[1]
    stored = mapping.where(F.col("placeholder").isin("«SECRET_1»", "«SECRET_2»"))
    return redaction.new_mappings(mapping, stored).select("incident_id", "placeholder", "value")


@query(
    "r5_rehydrated_lines",
    with_views(["v_log_lines"], "SELECT line_no AS text_id, raw AS restored FROM v_log_lines"),
)
def rehydrated(spark, sf_dir):
    detected, mapping = _redacted(spark, sf_dir)
    texts = redaction.redact(detected, mapping).select("incident_id", "text_id", F.col("redacted").alias("text"))
    return redaction.rehydrate(texts, mapping).select("text_id", "restored")


@query(
    "r6_redaction_counts",
    with_views(
        ["v_log_lines"],
        _TOKENS + """ SELECT incident_id, 'SECRET' AS type, count(*) AS "values" FROM map GROUP BY 1""",
    ),
)
def redaction_counts(spark, sf_dir):
    return redaction.redaction_counts(_redacted(spark, sf_dir)[1])


# passwords that hold access keys, uploaded twice: first the even lines, then all of them
_NESTED = """n0 AS (SELECT incident_id, line_no, concat('AKIA', lpad(CAST(line_no % 5 AS STRING), 16, '0')) AS inner_value FROM v_log_lines),
n1 AS (SELECT *, concat('p', inner_value, 'q', CAST(line_no % 11 AS STRING)) AS value FROM n0)"""
_NUMBERED = """f AS (SELECT incident_id, kind, value, min(CASE WHEN line_no % 2 = 0 THEN line_no END) AS one, min(line_no) AS two FROM (
  SELECT incident_id, line_no, 'AWS_KEY' AS kind, inner_value AS value FROM n1 UNION ALL SELECT incident_id, line_no, 'PASSWORD', value FROM n1) GROUP BY 1, 2, 3),
m AS (SELECT incident_id, kind, value, concat('«', kind, '_', CAST(row_number() OVER (PARTITION BY incident_id, kind ORDER BY one IS NULL, one, two) AS VARCHAR), '»') AS placeholder FROM f)"""


def _nested_texts(spark, sf_dir):
    lines = view(spark, sf_dir, "v_log_lines")
    inner = F.concat(F.lit("AKIA"), F.lpad((F.col("line_no") % 5).cast("string"), 16, "0"))
    value = F.concat(F.lit("open postgres://app:p"), inner, F.lit("q"), (F.col("line_no") % 11).cast("string"), F.lit("@db/x"))
    return lines.select("incident_id", F.col("line_no").alias("text_id"), F.col("line_no").alias("text_seq"), value.alias("text"))


def _reuploaded(spark, sf_dir):
    """(scanned texts of the second upload, stored map of the first, new rows of the second)."""
    texts = _nested_texts(spark, sf_dir)
    one = settle(redaction.detect_sensitive(texts.where("text_id % 2 = 0")))
    stored = settle(redaction.number_placeholders(redaction.sensitive_hits(one)).drop("token"))
    two = settle(redaction.detect_sensitive(texts))
    return two, stored, redaction.number_placeholders(redaction.sensitive_hits(two), stored)


@query(
    "r3_reuploaded_lines",
    with_views(
        ["v_log_lines"],
        _NESTED + ", " + _NUMBERED
        + """ SELECT line_no AS text_id, concat('open postgres://app:', placeholder, '@db/x') AS redacted, concat('open postgres://app:', n1.value, '@db/x') AS restored
FROM n1 JOIN m ON m.incident_id = n1.incident_id AND m.value = n1.value AND kind = 'PASSWORD'""",
    ),
)
def reuploaded_lines(spark, sf_dir):
    detected, stored, fresh = _reuploaded(spark, sf_dir)
    mapping = settle(fresh.unionByName(redaction.with_tokens(stored)))
    done = settle(redaction.redact(detected, mapping).select("incident_id", "text_id", "redacted"))
    return redaction.rehydrate(done, mapping, "redacted").select("text_id", "redacted", "restored")


@query(
    "r4_reuploaded_map",
    with_views(
        ["v_log_lines"],
        _NESTED + ", " + _NUMBERED
        + """, i AS (SELECT DISTINCT incident_id, inner_value, value FROM n1)
SELECT m.incident_id, m.placeholder, m.kind AS type, CASE WHEN m.kind = 'AWS_KEY' THEN m.value ELSE replace(m.value, i.inner_value, k.placeholder) END AS value
FROM m LEFT JOIN i ON i.incident_id = m.incident_id AND i.value = m.value AND m.kind = 'PASSWORD'
LEFT JOIN m k ON k.incident_id = i.incident_id AND k.value = i.inner_value AND k.kind = 'AWS_KEY'""",
    ),
)
def reuploaded_map(spark, sf_dir):
    _, stored, fresh = _reuploaded(spark, sf_dir)
    return stored.unionByName(fresh.drop("token"))


@query(
    "r5_rehydrated_payloads",
    with_views(["v_log_lines"], """SELECT line_no AS text_id, concat('saw pa"ss', chr(92), CAST(line_no % 7 AS VARCHAR), ' here') AS seen, line_no AS n FROM v_log_lines"""),
)
def rehydrated_payloads(spark, sf_dir):
    lines = view(spark, sf_dir, "v_log_lines")
    value = F.concat(F.lit('pa"ss\\'), (F.col("line_no") % 7).cast("string"))
    texts = lines.select(
        "incident_id", F.col("line_no").alias("text_id"), F.col("line_no").alias("text_seq"),
        F.concat(F.lit("open db://app:"), value, F.lit("@db/x")).alias("text"),
    )
    detected = settle(redaction.detect_sensitive(texts))
    mapping = settle(redaction.number_placeholders(redaction.sensitive_hits(detected)))
    found = redaction.redact(detected, mapping).withColumn("_p", F.regexp_extract("redacted", "(«[A-Z_]+_[0-9]+»)", 1))
    payload = F.to_json(F.struct(F.concat(F.lit("saw "), "_p", F.lit(" here")).alias("seen"), F.col("text_id").alias("n")))
    back = redaction.rehydrate(found.select("incident_id", "text_id", payload.alias("text")), mapping, json=True)
    return back.select("text_id", F.from_json("restored", "seen string, n long").alias("r")).select("text_id", "r.*")


_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1
  THEN CASE WHEN CAST(d[i] AS INT) >= 5 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) % 10 = 0"""


@query(
    "r2_card_candidates",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:[0-9][ -]?){{13,19}}\\b')) AS v FROM documents),
n AS (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM c)
SELECT doc_id, v AS value, length(d) BETWEEN 13 AND 19 AND {_LUHN} AS is_card FROM n""",
)
def card_candidates(spark, sf_dir):
    from signalweir.functions.redaction import card_number

    card = next(d for d in DETECTORS if d.card)
    found = F.regexp_extract_all("text", F.lit(card.pattern), F.lit(2))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("value"))
    return docs.withColumn("is_card", card_number(F.col("value")))


@query("r1_document_hits")
def document_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("incident_id"), F.col("doc_id").alias("text_id"), F.col("doc_id").alias("text_seq"), "text"
    )
    return redaction.sensitive_hits(redaction.detect_sensitive(docs)).select("text_id", "type", "position", "value")


@query(
    "f41_encryption_round_trip",
    with_views(["v_log_lines"], "SELECT line_no, raw AS opened, true AS sealed FROM v_log_lines"),
)
def encryption(spark, sf_dir):
    lines = view(spark, sf_dir, "v_log_lines")
    key = F.unhex(F.sha2(F.concat(F.lit("demo:"), F.col("tenant_id")), 256))
    stored = lines.withColumn("stored", redaction.encrypt_col(F.col("raw"), key))
    return stored.select(
        "line_no",
        redaction.decrypt_col(F.col("stored"), key).alias("opened"),
        (F.col("stored").startswith(redaction.MARKER) & ~F.contains(F.col("stored"), F.col("raw"))).alias("sealed"),
    )

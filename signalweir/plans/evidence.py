"""Log upload to stored evidence: reduce, redact, encrypt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.operators import logs, redaction
from signalweir.session import settle


def prepare_evidence(
    lines: DataFrame, key: Column | None = None, stored_map: DataFrame | None = None, **budget: int
) -> tuple[DataFrame, DataFrame]:
    """(evidence, new mappings) of line rows incident_id, source_file, line_no, raw.

    Each file is cut to its retained lines, whose size is bounded, and becomes one text, so
    that values spanning lines are found too.  `key` may use incident_id; without one the
    text is stored as it is.
    """
    kept = logs.retain_lines(logs.prepare_lines(lines), **budget)
    texts = logs.retained_text(kept).select(
        "incident_id", "source_file", "text", F.concat_ws("\x01", "incident_id", "source_file").alias("text_id"),
        F.col("source_file").alias("text_seq"),
    )
    detected = settle(redaction.detect_sensitive(texts))
    fresh = redaction.number_placeholders(redaction.sensitive_hits(detected), stored_map)
    mapping = fresh if stored_map is None else fresh.unionByName(redaction.with_tokens(stored_map))
    swapped = redaction.redact(detected, mapping)
    body = F.col("redacted") if key is None else redaction.encrypt_col(F.col("redacted"), key)
    return swapped.select("incident_id", "source_file", body.alias("extracted_data")), fresh.drop("token")


def signal_evidence(signals: DataFrame) -> DataFrame:
    """The evidence text an attached signal leaves behind."""
    head = F.concat(F.lit("["), "source", F.lit("] "), "severity", F.lit(" on "), "entity")
    return signals.select(
        "incident_id",
        F.concat(F.col("source"), F.lit("-signal")).alias("source_file"),
        F.col("signal_id").alias("text_id"),
        F.col("signal_no").alias("text_seq"),
        F.concat_ws("\n", head, "title", "message").alias("text"),
    )

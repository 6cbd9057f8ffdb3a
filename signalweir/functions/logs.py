"""Column expressions over single log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalweir.functions.text import EDGE_L, EDGE_R, WS

# The three timestamp shapes looked for, in order.
ISO_STAMP = r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?)"
PLAIN_STAMP = r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"
APACHE_STAMP = r"([0-9]{2}/[A-Za-z0-9_]{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2})"

# Words that mark a line as severe (3), error (2) or warning (1).
SEVERE_WORDS = "FATAL|CRITICAL|EMERG|ALERT|PANIC|SEGFAULT"
ERROR_WORDS = r"ERROR|EXCEPTION|Traceback|Caused by"
STACK_FRAME = r"at [A-Za-z0-9_.$]+\([A-Za-z0-9_.]+:[0-9]+\)"
WARNING_WORDS = "WARN|WARNING"


def log_timestamp(c: Column) -> Column:
    """The timestamp text of a line as it stands, or null."""
    found = [F.regexp_extract(c, p, 1) for p in (ISO_STAMP, PLAIN_STAMP, APACHE_STAMP)]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def sort_instant(stamp: Column) -> Column:
    """The instant a stamp sorts by; null (sorts last) for shapes that do not parse."""
    iso_like = stamp.rlike(r"^[0-9]{4}-")
    return F.when(iso_like, stamp).try_cast("timestamp")


def severity_class(c: Column) -> Column:
    high = c.rlike(f"(?i){EDGE_L}(?:{SEVERE_WORDS}){EDGE_R}|panic:")
    mid = c.rlike(f"(?i){EDGE_L}(?:(?:{ERROR_WORDS}){EDGE_R}|{STACK_FRAME}(?=[A-Za-z0-9_]))")
    low = c.rlike(f"(?i){EDGE_L}(?:{WARNING_WORDS}){EDGE_R}")
    return F.when(high, 3).when(mid, 2).when(low, 1).otherwise(0)


def line_key(c: Column) -> Column:
    """Two lines with the same key are the same line for dedup."""
    return F.regexp_replace(F.lower(c), f"{WS}+", "")


def fused_line(source: Column, stamp: Column, raw: Column) -> Column:
    return F.concat(
        F.lit("["), source, F.lit("] "), F.coalesce(stamp, F.lit("no-timestamp")), F.lit(" | "), raw
    )

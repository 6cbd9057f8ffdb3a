"""Column expressions that normalise, score and identify alert signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalweir.functions.text import WS, strip_ws

# Fixed values of the scoring model (weights of a logistic score).
INTERCEPT = -4.0
WEIGHT_SEVERITY = 4.0
WEIGHT_KEYWORDS = 1.2
WEIGHT_RESOLVED = -6.0
WEIGHT_BREACH = 1.0
KEYWORD_CAP = 3
COST_FALSE_POSITIVE = 1.0
COST_FALSE_NEGATIVE = 20.0

# Failure vocabulary counted in title and message.
FAILURE_TERMS = [
    "timeout", "timed out", "exhausted", "saturat", "panic", "oom",
    "out of memory", "deadlock", "refused", "unavailable", "unreachable",
    "5xx", "crashloop", "circuit breaker", "data loss", "corrupt",
]

# Severity names by ordinal; any other name counts as 0.4.
SEVERITY_NAMES = {
    1.0: ["critical", "crit", "fatal", "emergency", "p1"],
    0.8: ["error", "err", "high", "p2"],
    0.4: ["warning", "warn", "medium", "p3"],
    0.0: ["info", "information", "low", "debug", "p4"],
}
UNKNOWN_SEVERITY = 0.4

REPLICA_SUFFIX = r"[-_](?:[0-9a-f]{4,10}|[0-9]+)\z"


def severity_ordinal(c: Column) -> Column:
    name = F.lower(c)
    out = F.lit(None).cast("double")
    for value, names in SEVERITY_NAMES.items():
        out = F.when(name.isin(names), F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(UNKNOWN_SEVERITY))


def keyword_count(title: Column, message: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(message, F.lit(""))))
    hits = F.lit(0)
    for term in FAILURE_TERMS:
        hits = hits + F.contains(text, F.lit(term)).cast("int")
    return F.least(hits, F.lit(KEYWORD_CAP))


def anomaly_score(severity: Column, keywords: Column, resolved: Column, breach: Column) -> Column:
    z = (
        F.lit(INTERCEPT)
        + severity * WEIGHT_SEVERITY
        + keywords * WEIGHT_KEYWORDS
        + resolved * WEIGHT_RESOLVED
        + breach * WEIGHT_BREACH
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def cost_threshold(false_positive: Column, false_negative: Column) -> Column:
    """The score above which escalating is the cheaper mistake."""
    return false_positive / (false_positive + false_negative)


def normalize_entity(c: Column) -> Column:
    name = strip_ws(F.lower(F.coalesce(c, F.lit("unknown"))))
    return F.regexp_replace(F.regexp_replace(name, REPLICA_SUFFIX, ""), f"{WS}+", "-")


def fingerprint(tenant: Column, entity: Column) -> Column:
    return F.sha2(F.concat(tenant.cast("string"), F.char(F.lit(0)), normalize_entity(entity)), 256)


def normalize_state(c: Column) -> Column:
    cleared = F.lower(c).isin("resolved", "ok", "recovery", "success")
    return F.when(cleared, F.lit("resolved")).otherwise(F.lit("firing"))


def excerpt(title: Column, message: Column, max_chars: int = 500) -> Column:
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
    return F.substring(strip_ws(both), 1, max_chars)


def incident_title(entity: Column, title: Column, max_chars: int = 200) -> Column:
    named = F.coalesce(F.when(title != "", title), F.lit("unhealthy"))
    return F.substring(F.concat(entity, F.lit(": "), named), 1, max_chars)

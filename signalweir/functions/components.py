"""Component names: one spelling, plausibility, grounding, and names found in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalweir.functions.text import EDGE_L, EDGE_R, collapse_ws, strip_ws

# Bare infrastructure names.
SEED_COMPONENTS = [
    "postgres", "postgresql", "mysql", "mariadb", "mongodb", "redis", "memcached",
    "kafka", "rabbitmq", "nats", "elasticsearch", "opensearch", "clickhouse",
    "nginx", "haproxy", "envoy", "traefik", "zookeeper", "etcd", "consul", "vault",
]

# Last words of a service-shaped name.
COMPONENT_SUFFIXES = [
    "service", "svc", "api", "gateway", "db", "database", "cache", "queue",
    "worker", "proxy", "broker", "pooler", "cluster", "daemon", "agent",
    "server", "monitor", "scheduler", "consumer", "producer", "indexer",
]

# First words that make a phrase a description, not a name.
DESCRIPTIVE_HEADS = [
    "upstream", "downstream", "external", "internal", "remote", "local",
    "connection", "network", "database", "system", "application", "backend",
    "frontend", "unknown", "various", "multiple", "some", "other", "the", "a", "an",
    "primary", "secondary", "backup", "third", "party", "third-party",
]

# Last words that name a resource inside a component.
RESOURCE_TAILS = [
    "pool", "connection", "memory", "disk", "cpu", "thread", "buffer", "socket",
    "timeout", "latency", "throughput", "error", "errors", "rate", "limit",
    "quota", "usage", "load", "traffic", "request", "requests", "response",
]

_SEEDS = f"{EDGE_L}({'|'.join(SEED_COMPONENTS)}){EDGE_R}"
_CONVENTION = f"{EDGE_L}([a-z][a-z0-9]*(?:[-_][a-z0-9]+)*?[-_](?:{'|'.join(COMPONENT_SUFFIXES)})){EDGE_R}"


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn` of a value that is worked out once, however often `fn` names it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def normalize_component(c: Column) -> Column:
    # bound: the choice inside reads the name more than once
    name = bound(strip_ws(F.lower(F.coalesce(c, F.lit("")))), lambda n: collapse_ws(n, "_", "-"))
    return F.rtrim(F.regexp_replace(name, r"-(?:[0-9a-f]{4,10}|[0-9]+)\z", ""), F.lit("-"))


def is_plausible(c: Column) -> Column:
    """A name rather than a description: tested on its first and last word only."""
    return bound(normalize_component(c), plausible_name)


def plausible_name(name: Column) -> Column:
    """`is_plausible` for a name that is normalised already."""
    head = F.substring_index(name, "-", 1)
    tail = F.substring_index(name, "-", -1)
    compound = F.contains(name, F.lit("-"))
    return (F.length(name) >= 3) & ~head.isin(DESCRIPTIVE_HEADS) & ~(compound & tail.isin(RESOURCE_TAILS))


def evidence_key(text: Column) -> Column:
    return bound(F.lower(text), lambda t: collapse_ws(t, "_", "-"))


def is_grounded(c: Column, evidence: Column) -> Column:
    """The evidence mentions the component; without evidence everything passes."""
    empty = evidence.isNull() | (evidence == "")
    return empty | bound(normalize_component(c), lambda name: (name != "") & F.contains(evidence_key(evidence), name))


def named_in_text(text: Column) -> Column:
    """Seed names (in their listed order), then names by convention (in text order), distinct."""
    low = F.lower(F.coalesce(text, F.lit("")))
    seeds = F.regexp_extract_all(low, F.lit(_SEEDS), F.lit(1))
    listed = F.array(*[F.lit(s) for s in SEED_COMPONENTS])
    by_rule = F.transform(F.regexp_extract_all(low, F.lit(_CONVENTION), F.lit(1)), normalize_component)
    return F.array_distinct(F.concat(F.array_intersect(listed, seeds), F.filter(by_rule, lambda n: n != "")))


def mentions(text: Column, name: Column) -> Column:
    """How often the name stands in the text as a word."""
    pattern = F.concat(F.lit(EDGE_L + r"\Q"), name, F.lit(r"\E" + EDGE_R))
    return F.call_function("regexp_count", F.lower(text), pattern)

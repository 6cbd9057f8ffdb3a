"""Merge-shaped operators: upserts, fenced writes, running totals, deletes, dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.scale import OrderedSlices


def incident_counters(attached: DataFrame) -> DataFrame:
    """What an upsert per signal would have left behind: counter, created and reopened flags."""
    return attached.groupBy("incident_id").agg(
        F.count("*").alias("signal_count"),
        F.count_if(F.col("event_type") == "incident-opened").alias("created"),
        F.count_if(F.col("event_type") == "incident-reopened").alias("reopened"),
    )


def add_counters(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Stored counters with those of another batch of signals added."""
    counts = [c for c in stored.columns if c != "incident_id"]
    return stored.unionByName(more).groupBy("incident_id").agg(*(F.sum(c).alias(c) for c in counts))


def accepted_writes(writes: DataFrame, key: str = "report_id") -> DataFrame:
    """Mark each write accepted or fenced off.

    A write passes when its token is at least every token written before it; a write without
    a token is unconditional and leaves the fence where it is.  `writes`: key, token, arrival.
    """
    scan = OrderedSlices(writes, [key], [F.col("arrival").asc()])
    scan.running_max("_fence", F.col("token"), inclusive=False)
    passes = F.col("token").isNull() | F.col("_fence").isNull() | (F.col("token") >= F.col("_fence"))
    return scan.frame().withColumn("accepted", passes).drop("_fence")


def fenced_merge(writes: DataFrame, columns: Sequence[str], key: str = "report_id") -> DataFrame:
    """Last accepted value per column; a write that leaves a column null does not touch it."""
    kept = accepted_writes(writes, key).where("accepted")
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c) for c in columns
    ]
    return kept.groupBy(key).agg(
        F.max("token").alias("fence_token"), F.count("*").alias("accepted_writes"), *last
    )


def dedupe_payloads(payloads: DataFrame, keys: Sequence[str] = ("tenant_id", "incident_id", "input_hash")) -> DataFrame:
    """The first payload per (tenant, incident, hash).  A partial aggregate finds it, so copies never gather."""
    rest = [c for c in payloads.columns if c not in keys]
    order = [c for c in ("created_at", "payload_id") if c in rest]
    first = payloads.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"))
    return first.select(*keys, "_first.*").select(*payloads.columns)


def running_baseline(payloads: DataFrame, threshold: int = 10000, modulus: int = 65536) -> DataFrame:
    """Running total per tenant in 16-bit arithmetic, flagged when it reaches the threshold."""
    scan = OrderedSlices(payloads, ["tenant_id"], [F.col("created_at").asc(), F.col("payload_id").asc()])
    scan.running_sum("_sum", F.col("amount"))
    return (
        scan.frame()
        .withColumn("baseline", F.pmod(F.col("_sum"), F.lit(modulus)))
        .withColumn("anomaly", F.col("baseline") >= threshold)
        .drop("_sum")
    )


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest-wins upsert: the greatest row per key by `order`, found by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the incoming rows whose key is not stored yet, one per key."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def migrate_status(incidents: DataFrame) -> DataFrame:
    """Old status vocabulary to the new one."""
    return incidents.withColumn(
        "status", F.when(F.col("status") == "pending", F.lit("open")).otherwise(F.col("status"))
    )


def backfill_slugs(organizations: DataFrame, slug: str = "ingest_slug", key: str = "organization_id") -> DataFrame:
    """Fill missing slugs with a stable 32-digit hex value of the key."""
    made = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 32)
    return organizations.withColumn(slug, F.coalesce(F.col(slug), made))

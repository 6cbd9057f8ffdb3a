"""Incident lifecycle in batch: sessions per (tenant, fingerprint), flaps, sweeps, events.

Time is event time with no sweep delay: an incident resolves `silence` after its last
signal; a signal within `cooldown` of that moment reopens it, a later one opens a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweir.functions.signals import incident_title
from signalweir.scale import OrderedSlices
from signalweir.session import settle

SILENCE_MINUTES = 30
COOLDOWN_MINUTES = 15
_MICROS = 60 * 1_000_000
_KEYS = ["tenant_id", "fingerprint"]


def incident_id(tenant: Column, fingerprint: Column, opened_micros: Column) -> Column:
    """The same incident gets the same id on every run."""
    return F.sha2(F.concat_ws("|", tenant, fingerprint, opened_micros.cast("string")), 256)


def _resolution(silence: int) -> Column:
    return F.lit(f"auto-resolved: no signals for {silence}m")


def signal_blocks(signals: DataFrame, silence: int = SILENCE_MINUTES, cooldown: int = COOLDOWN_MINUTES) -> DataFrame:
    """Signals folded into blocks shorter than the silence: tenant_id, fingerprint, block, first_at, last_at, signals.

    The fold is a map-side partial aggregate on plain numbers: at most one row per key and
    block of wall-clock time, however many signals the key has.
    """
    width = min(silence, cooldown) * _MICROS if cooldown > 0 else silence * _MICROS
    width = min(width, silence * _MICROS)
    at = F.unix_micros("created_at")
    return (
        signals.select(*_KEYS, at.alias("_at"))
        .groupBy(*_KEYS, F.floor(F.col("_at") / F.lit(width)).alias("block"))
        .agg(F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count("*").alias("signals"))
    )


def fold_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of several batches of signals as those of all: they add up in any order."""
    return blocks.groupBy(*_KEYS, "block").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("signals").alias("signals")
    )


def mark_blocks(blocks: DataFrame, silence: int = SILENCE_MINUTES, cooldown: int = COOLDOWN_MINUTES) -> DataFrame:
    """Blocks with gap, opens, reopens and incident_no.  No gap inside a block can end an incident."""
    w = Window.partitionBy(*_KEYS).orderBy("block")
    gap = F.col("first_at") - F.lag("last_at").over(w)
    blocks = blocks.withColumn("gap", gap)
    opens = F.col("gap").isNull() | (F.col("gap") >= (silence + cooldown) * _MICROS)
    return (
        blocks.withColumn("opens", opens)
        .withColumn("reopens", ~opens & (F.col("gap") > silence * _MICROS))
        .withColumn("incident_no", F.sum(F.col("opens").cast("bigint")).over(w))
    )


def activity_blocks(signals: DataFrame, silence: int = SILENCE_MINUTES, cooldown: int = COOLDOWN_MINUTES) -> DataFrame:
    """Signals folded into blocks, marked with incident and episode starts."""
    return mark_blocks(signal_blocks(signals, silence, cooldown), silence, cooldown)


def block_sessions(marked: DataFrame) -> DataFrame:
    """One row per incident of marked blocks, with its span, signal count and number of reopens."""
    return (
        marked.groupBy(*_KEYS, "incident_no")
        .agg(
            F.min("first_at").alias("opened_at"),
            F.max("last_at").alias("last_seen_at"),
            F.sum("signals").alias("signal_count"),
            F.sum(F.col("reopens").cast("bigint")).alias("reopen_count"),
        )
        .withColumn("incident_id", incident_id(F.col("tenant_id"), F.col("fingerprint"), F.col("opened_at")))
        .withColumn("opened_at", F.timestamp_micros("opened_at"))
        .withColumn("last_seen_at", F.timestamp_micros("last_seen_at"))
    )


def incident_sessions(
    signals: DataFrame, silence: int = SILENCE_MINUTES, cooldown: int = COOLDOWN_MINUTES
) -> DataFrame:
    """One row per incident with its span, signal count and number of reopens."""
    return block_sessions(activity_blocks(signals, silence, cooldown))


def incident_rollup(
    signals: DataFrame,
    as_of: Column,
    silence: int = SILENCE_MINUTES,
    cooldown: int = COOLDOWN_MINUTES,
) -> DataFrame:
    """The incidents table as of a moment: counters, status, and title from the opening signal."""
    sessions = incident_sessions(signals, silence, cooldown)
    opening = (
        signals.join(
            sessions.select(*_KEYS, F.col("opened_at").alias("created_at"), "incident_id"), [*_KEYS, "created_at"]
        )
        .groupBy("incident_id")
        .agg(F.min_by(F.struct("entity", "title", "message"), "signal_id").alias("_first"))
        .select(
            "incident_id",
            F.col("_first.entity").alias("entity"),
            incident_title(F.col("_first.entity"), F.col("_first.title")).alias("title"),
            F.substring("_first.message", 1, 2000).alias("description"),
        )
    )
    rows = sessions.join(opening, "incident_id").withColumn("status", F.lit("open"))
    rows = rows.withColumn("resolved_at", F.lit(None).cast("timestamp")).withColumn(
        "resolution", F.lit(None).cast("string")
    )
    return resolve_stale(rows, as_of, silence)


def is_stale(as_of: Column, silence: int = SILENCE_MINUTES) -> Column:
    quiet_since = F.unix_micros(as_of) - F.lit(silence * _MICROS)
    return (
        (F.col("status") == "open")
        & F.col("fingerprint").isNotNull()
        & (F.unix_micros("last_seen_at") < quiet_since)
    )


def resolve_stale(incidents: DataFrame, as_of: Column, silence: int = SILENCE_MINUTES) -> DataFrame:
    """Resolve open signal-driven incidents gone quiet; hand-opened ones stay.  Idempotent."""
    stale = F.coalesce(is_stale(as_of, silence), F.lit(False))
    closed_at = F.timestamp_micros(F.unix_micros("last_seen_at") + F.lit(silence * _MICROS))
    return incidents.withColumns(
        {
            "resolved_at": F.when(stale, closed_at).otherwise(F.col("resolved_at")),
            "resolution": F.when(stale, _resolution(silence)).otherwise(F.col("resolution")),
            "status": F.when(stale, F.lit("resolved")).otherwise(F.col("status")),
        }
    )


def reopen_candidates(
    incidents: DataFrame, signals: DataFrame, cooldown: int = COOLDOWN_MINUTES
) -> DataFrame:
    """For each new signal, the most recently resolved incident it reopens, if any.

    `signals` carries tenant_id, fingerprint, signal_id, created_at.  Joined on cooldown-wide
    time slots, so a hot key never meets its whole history of incidents.
    """
    width = cooldown * _MICROS
    resolved = incidents.where(F.col("status") == "resolved").select(
        *_KEYS, "incident_id", "resolved_at", F.floor(F.unix_micros("resolved_at") / width).alias("_slot")
    )
    slot = F.floor(F.unix_micros("created_at") / width)
    probes = signals.select(
        *_KEYS, "signal_id", "created_at", F.explode(F.array(slot, slot - 1)).alias("_slot")
    )
    since = F.unix_micros("created_at") - F.lit(width)
    return (
        probes.join(resolved, [*_KEYS, "_slot"])
        .where((F.unix_micros("resolved_at") > since) & (F.col("resolved_at") <= F.col("created_at")))
        .groupBy("signal_id")
        .agg(F.max_by("incident_id", F.struct("resolved_at", "incident_id")).alias("incident_id"))
    )


def attach_signals(signals: DataFrame, silence: int = SILENCE_MINUTES, cooldown: int = COOLDOWN_MINUTES) -> DataFrame:
    """Every escalated signal with its incident, its place in it, and what it did to it.

    Scans slices of a key, so the hottest entity is spread over many tasks.
    """
    at = F.unix_micros("created_at")
    # settled first: choosing slice borders reads the rows once more, and they carry the triage
    rows = settle(signals.withColumn("_at", at))
    scan = OrderedSlices(rows, _KEYS, [F.col("_at").asc(), F.col("signal_id").asc()])
    scan.previous("_prev", F.col("_at"))
    gap = F.col("_at") - F.col("_prev")
    opens = F.col("_prev").isNull() | (gap >= (silence + cooldown) * _MICROS)
    scan.df = scan.df.withColumn("_opens", opens).withColumn("_reopens", ~opens & (gap > silence * _MICROS))
    scan.rank("_nth")
    scan.running_max("_start_nth", F.when(F.col("_opens"), F.col("_nth")))
    scan.running_max("_start_at", F.when(F.col("_opens"), F.col("_at")))
    return (
        scan.frame()
        .withColumn("incident_id", incident_id(F.col("tenant_id"), F.col("fingerprint"), F.col("_start_at")))
        .withColumn("signal_no", F.col("_nth") - F.col("_start_nth") + 1)
        .withColumn(
            "event_type",
            F.when(F.col("_opens"), F.lit("incident-opened"))
            .when(F.col("_reopens"), F.lit("incident-reopened"))
            .otherwise(F.lit("signal-attached")),
        )
        .drop("_at", "_prev", "_opens", "_reopens", "_nth", "_start_nth", "_start_at")
    )


def analysis_triggers(attached: DataFrame) -> DataFrame:
    """One row per created incident; a reopened one never triggers again."""
    return attached.where(F.col("event_type") == "incident-opened").select(
        "tenant_id", "incident_id", "signal_id", F.col("created_at").alias("triggered_at")
    )


def lifecycle_events(
    attached: DataFrame, blocks: DataFrame, as_of: Column, silence: int = SILENCE_MINUTES
) -> DataFrame:
    """The event feed: opened, attached, reopened per signal, and resolved per ended episode."""
    per_signal = attached.select(
        "tenant_id", "incident_id", "event_type", F.col("created_at").alias("event_at"),
        "signal_no", "signal_id",
    )
    w = Window.partitionBy(*_KEYS).orderBy("block")
    started = F.last(F.when(F.col("opens"), F.col("first_at")), ignorenulls=True).over(w)
    next_gap = F.lead("gap").over(w)
    ended = F.when(
        next_gap.isNull(), F.unix_micros(as_of) - F.col("last_at") > silence * _MICROS
    ).otherwise(next_gap > silence * _MICROS)
    resolved = (
        blocks.withColumn("_start", started)
        .withColumn("_ended", ended)
        .withColumn("_upto", F.sum("signals").over(Window.partitionBy(*_KEYS, "incident_no").orderBy("block")))
        .where("_ended")
        .select(
            "tenant_id",
            incident_id(F.col("tenant_id"), F.col("fingerprint"), F.col("_start")).alias("incident_id"),
            F.lit("resolved").alias("event_type"),
            F.timestamp_micros(F.col("last_at") + F.lit(silence * _MICROS)).alias("event_at"),
            F.col("_upto").alias("signal_no"),
            F.lit(None).cast("bigint").alias("signal_id"),
        )
    )
    return per_signal.unionByName(resolved)

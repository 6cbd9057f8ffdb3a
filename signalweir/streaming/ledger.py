"""Stored state beside the streams: late signals, and the newest version of every document.

The keyed stream answers at once and drops what lies behind its watermark. The ledger keeps
every signal as part of its activity block, a few numbers that add up in any order, so a
late row only changes its block, and incidents read from the blocks are those of the batch
operator over all signals. Both ledgers are stored tables: a micro-batch counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from signalweir.operators import lifecycle
from signalweir.operators.merge import latest_rows
from signalweir.sources.tables import StoredTable, merge_batches

BLOCKS = "tenant_id string, fingerprint string, block long, first_at long, last_at long, signals long"


def block_ledger(
    spark: SparkSession, path: str, silence: int = lifecycle.SILENCE_MINUTES, cooldown: int = lifecycle.COOLDOWN_MINUTES, buckets: int = 16
):
    """A stored table of activity blocks, and the foreachBatch function that fills it from escalated signals."""
    table = StoredTable(spark, path, BLOCKS, ["tenant_id", "fingerprint", "block"], buckets)

    def prepare(batch: DataFrame) -> DataFrame:
        return lifecycle.signal_blocks(batch, silence, cooldown)

    return table, merge_batches(table, prepare, lambda stored, more: lifecycle.fold_blocks(stored.unionByName(more)))


def reconciled_incidents(table: StoredTable, silence: int = lifecycle.SILENCE_MINUTES, cooldown: int = lifecycle.COOLDOWN_MINUTES) -> DataFrame:
    """Incidents of all signals that the ledger has seen, in whatever order they came."""
    return lifecycle.block_sessions(lifecycle.mark_blocks(table.read(), silence, cooldown))


def late_signals(signals: DataFrame, events: DataFrame) -> DataFrame:
    """The signals that the keyed stream never answered: the side table of what its watermark dropped."""
    answered = events.where("signal_id IS NOT NULL").select("signal_id")
    return signals.join(answered, "signal_id", "left_anti")


def version_ledger(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 16):
    """A stored table of the newest row by `version` of each key, and the foreachBatch function that guards it.

    A batch with older versions than those stored changes nothing, and so does a batch that
    comes again. Of equal versions in one batch the greatest row stays.
    """
    table = StoredTable(spark, path, schema, keys, buckets)
    order = ["version", *(c for c in table.empty.columns if c not in (*keys, "version"))]

    def newest(stored: DataFrame, more: DataFrame) -> DataFrame:
        return latest_rows(stored.unionByName(more.select(*stored.columns)), keys, order)

    return table, merge_batches(table, lambda batch: batch, newest)

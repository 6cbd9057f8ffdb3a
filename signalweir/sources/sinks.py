"""Table reads and writes: tenant-partitioned appends, feeds, and streaming sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scan(spark: SparkSession, path: str, tenant_id: str | None = None) -> DataFrame:
    """A stored table, of one tenant when asked; the tenant filter prunes partitions."""
    rows = spark.read.parquet(path)
    return rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)


def append_rows(rows: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append to a table partitioned by tenant (and by day of a timestamp)."""
    by = ["tenant_id"]
    if day_of:
        rows, by = rows.withColumn("day", F.to_date(day_of)), [*by, "day"]
    rows.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions the rows fall into; repeating the write changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def split_sink(accepted_path: str, suppressed_path: str, on_escalated: Callable[[DataFrame, int], None] | None = None):
    """A foreachBatch function that stores every decision and hands on the escalated ones.

    Each batch overwrites its own partition, so a batch replayed after a failure is stored once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        tagged = held.withColumn("batch_id", F.lit(batch_id))
        replace_partitions(tagged.where("escalated"), accepted_path, ["batch_id"])
        replace_partitions(tagged.where("NOT escalated"), suppressed_path, ["batch_id"])
        if on_escalated is not None:
            on_escalated(held.where("escalated"), batch_id)
        held.unpersist()

    return write


def stream_to(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to parquet, all that is available now, exactly once."""
    return (
        rows.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

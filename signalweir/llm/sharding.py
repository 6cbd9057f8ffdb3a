"""Sharding by proportional stratified interleaving.

Rows of each stratum (source) are put in a seeded random order and ranked; the rank is
divided by the stratum's size, and all rows are ordered by that fraction. Any run of the
order then holds the strata in the proportions of the whole, so cutting it into equal runs
gives shards that match the mixture and differ by one row at most.

Both rankings run over range partitions (`OrderedSlices`): a stratum with a third of all
rows spans as many slices as its size asks for, and slices meet in a table of at most one
row a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.scale import OrderedSlices


def interleave(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source", seed: int = 7) -> DataFrame:
    """One row per input row: id, size, text_crc32, stratum, position, shard, slot.

    size is the text's UTF-8 bytes plus 8; null texts have none. Null strata are one
    stratum. Rows that repeat each other wholly are told apart by nothing and take
    neighbouring places. Counts differ by one at most, also when there are fewer rows
    than shards. An empty table gives an empty result.
    """
    data = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(data), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.col(stratum).alias("stratum"),
    ).withColumn("_mix", F.xxhash64(F.lit(seed), "id", "text_crc32", "stratum"))
    order = [F.col("_mix"), F.col("id"), F.col("text_crc32"), F.col("size")]
    ranked = OrderedSlices(rows, ["stratum"], order).rank("_rank")
    sizes = ranked.df.groupBy("stratum").agg(F.count("*").alias("_rows"))
    placed = ranked.frame().join(sizes.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("_part", F.expr("((2 * _rank - 1) * 1e0) / (2 * _rows)"))
    line = OrderedSlices(placed, [], [F.col("_part"), *order, F.col("stratum")]).rank("position")
    out = line.frame().withColumn("position", F.col("position") - 1)
    base, more = divmod(line.df.count(), shards)  # the first `more` shards have one row more
    long_part = more * (base + 1)
    shard = F.expr(
        f"CAST(CASE WHEN position < {long_part} THEN position div {base + 1} ELSE {more} + (position - {long_part}) div {max(base, 1)} END AS INT)"
    )
    start = F.col("shard").cast("long") * base + F.least(F.col("shard").cast("long"), F.lit(more))
    return out.withColumn("shard", shard).withColumn("slot", (F.col("position") - start).cast("long")).select(
        "id", "size", "text_crc32", "stratum", "position", "shard", "slot"
    )

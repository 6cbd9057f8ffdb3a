"""Exact dedup by distributed most-significant-digit radix partitioning.

The key of a text is its byte length followed by its bytes (white space deleted). Level 0
splits all rows by the length and the first bytes; only parts with two rows or more go on.
Each further level splits a part by its next, wider run of bytes, until a part is a single
row or its texts have ended: then they are equal. Bytes are compared as they are, no digest
stands in for them.

Parts are counted with partial aggregates, so thousands of copies reach the shuffle as one
row a task, and the counts are joined back to the rows in sort-merge joins whose hot parts
Spark splits. Widths grow sixteenfold, so a level more serves texts sixteen times as long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.llm.common import written

BLANKS = " \t\n\x0b\x0c\r"


def squeezed(text):
    """The compared bytes: UTF-8 without `[\\x20\\x09-\\x0D]`, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, first: int = 64, growth: int = 16
) -> DataFrame:
    """One row per input row: _row, id, keep_id, group_size, kept, text_sha256 (and _doc, the row itself, if `carry`).

    The row with the most code points stays, then the smallest id (null ids last), then
    the first of rows that repeat each other: exactly one row of a group is kept. Null
    texts are empty and equal to each other and to blank ones. An empty table gives none.
    Other columns never meet the operator's own: they travel inside `_doc`.
    """
    text = F.col("_doc")[text_col] if carry else F.col("_text")
    source = docs.select(
        F.col(id_col).alias("id"), *([F.struct("*").alias("_doc")] if carry else [F.col(text_col).alias("_text")])
    )

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_norm", squeezed(text)).withColumns(
            {"_len": F.octet_length("_norm"), "_seg": F.substring("_norm", 1, first)}
        )

    shared = written(
        keyed(source).groupBy("_len", "_seg").agg(F.count("*").alias("_n")).where("_n > 1")
        .select(F.col("_len").alias("_glen"), F.col("_seg").alias("_gseg"), F.monotonically_increasing_id().alias("_part"))
    )
    # sort-merge at every size: a table of shared beginnings has no bound
    met = keyed(source).drop("_norm").join(shared.hint("merge"), (F.col("_len") == F.col("_glen")) & (F.col("_seg") == F.col("_gseg")), "left")
    norm = squeezed(text)
    base = written(
        met.select(
            F.monotonically_increasing_id().alias("_row"), "id", *(["_doc"] if carry else []), "_part", "_len",
            F.length(F.coalesce(text, F.lit(""))).alias("_points"), F.sha2(norm, 256).alias("text_sha256"),
            F.when(F.col("_part").isNotNull(), _from(norm, first)).alias("_rest"),
        )
    )
    live = base.where(F.col("_part").isNotNull()).select("_row", "id", "_part", "_len", "_points", "_rest")
    ended: list[DataFrame] = []
    seen, width = first, first * growth
    while not live.isEmpty():
        cut = live.withColumn("_seg", F.substring("_rest", 1, width))
        parts = written(
            cut.groupBy("_part", "_seg")
            .agg(F.count("*").alias("_n"), F.min(F.struct(-F.col("_points"), F.col("id").isNull(), "id", "_row")).alias("_keep"))
            .where("_n > 1")
            .select(F.col("_part").alias("_gpart"), F.col("_seg").alias("_gseg"), "_n", F.col("_keep.id").alias("_kid"),
                    F.col("_keep._row").alias("_krow"), F.monotonically_increasing_id().alias("_next"))
        )
        seen += width
        met = cut.join(parts, (F.col("_part") == F.col("_gpart")) & (F.col("_seg") == F.col("_gseg")))
        level = written(
            met.select(
                "_row", "id", F.col("_next").alias("_part"), "_len", "_points", "_n", "_kid", "_krow",
                F.when(F.col("_len") > seen, _from(F.col("_rest"), width)).alias("_rest"),
            )
        )
        ended.append(level.where(F.col("_len") <= seen).select(F.col("_row").alias("_erow"), "_n", "_kid", "_krow"))
        live = level.where(F.col("_len") > seen).select("_row", "id", "_part", "_len", "_points", "_rest")
        width *= growth
    out = base.select("_row", "id", *(["_doc"] if carry else []), "text_sha256")
    if not ended:
        return out.select("*", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.unionByName, ended)
    alone = F.col("_erow").isNull()
    return out.join(found, F.col("_row") == F.col("_erow"), "left").select(
        *out.columns,
        F.when(alone, F.col("id")).otherwise(F.col("_kid")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_krow") == F.col("_row"))).alias("kept"),
    )


def _from(data, width: int):
    """The bytes after the first `width`."""
    return F.substring(data, F.lit(width + 1), F.greatest(F.octet_length(data) - width, F.lit(0)))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were."""
    return exact_groups(docs, id_col, text_col, carry=True).where("kept").select("_doc.*")

"""Knowledge documents: whole files or JSON rows, checked before they enter the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweir.functions.text import strip_ws

MAX_DOC_BYTES = 10 * 1024 * 1024


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: the file name is both its title and its source_uri."""
    raw = spark.read.text(paths, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(name.alias("source_uri"), F.col("value").alias("content"))


def accept_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): empty and oversized documents are rejected with a reason."""
    blank = F.col("content").isNull() | (strip_ws(F.col("content")) == "")
    reason = F.when(blank, F.lit("empty")).when(F.octet_length("content") > MAX_DOC_BYTES, F.lit("too-large"))
    if "title" not in docs.columns:
        docs = docs.withColumn("title", F.col("source_uri"))
    marked = docs.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")

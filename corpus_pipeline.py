"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, as a table, and keeps whole rows with the
columns of documents; the last gives the pieces of packed sequences. Stages are written as
Parquet into the folder of spark.checkpoint.dir and read back, so each is judged on its own
input and a lost executor repeats no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweir.llm import decontaminate, exact_dedup, near_dedup, packing
from signalweir.llm import toxicity as tox
from signalweir.llm.common import read, small_batches
from signalweir.llm.queries import ADDED, VOCABULARY
from signalweir.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows among them, does not reject."""
    small_batches(spark)
    return tox.drop_toxic(docs, tox.fit(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash of five-word shingles, then their sets, similarity 0.8."""
    small_batches(spark)
    return near_dedup.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    small_batches(spark)
    return packing.pack(docs, VOCABULARY, added=ADDED).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: The learned and the geometric stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.withColumn("ids", F.hex("ids"))

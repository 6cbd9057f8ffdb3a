"""What the operators of this subpackage share: word tables, batch limits, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweir.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte tables. LOWER_TABLE only lowers A-Z; WORD_TABLE also turns every ASCII byte but 0-9 and a-z into a space.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Texts that one Arrow batch carries at most, in rows and bytes; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def words_of(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 bytes after lower-casing A-Z."""
    return data.translate(WORD_TABLE).split()


def tokens_of(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes after lower-casing A-Z (bytes.split cuts at exactly these six)."""
    return data.translate(LOWER_TABLE).split()


def as_bytes(texts: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes, null as empty."""
    for x in texts.cast(pa.binary()):
        yield x.as_py() or b""


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker holds at once; long texts make rows of very different size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def give_back() -> None:
    """Return to the system what a worker's allocators keep of a task's rows: it stays beside the JVM, idle, while later stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """`df` as a table in the shared checkpoint folder, read back.

    Cuts the lineage as checkpoint() does, but as compressed columns: later steps read
    only what they need. Values such as monotonically_increasing_id are fixed from here on.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column is called so (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

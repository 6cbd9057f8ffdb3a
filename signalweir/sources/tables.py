"""Tables that are merged into in place: copy-on-write by hash bucket, with a journal of batches.

Rows are spread over a fixed number of buckets by a hash of their key. A merge reads the
buckets that its rows fall into, writes those buckets anew under the batch's own version,
and only then the journal entry that says which version each bucket has. Readers follow the
last complete entry, so a merge is there as a whole or not at all: what an interrupted one
left behind is overwritten when its batch comes again, and a batch that is already in the
journal, or older than its last entry, changes nothing.

One writer at a time, with rising batch ids, as a streaming query gives them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweir.session import settle

BUCKET = "_bucket"


class StoredTable:
    """A table with unique `keys` and the given DDL `schema`, stored under `path`.

    `buckets` must be the same every time; about one for each few hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.empty = spark.createDataFrame([], schema)

    # --- files ---

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _listed(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _complete(self, path: str) -> bool:
        fs, where = self._fs(f"{path}/_SUCCESS")
        return fs.exists(where)

    def _version_path(self, version: int) -> str:
        return f"{self.path}/data/version={version}"

    def _entry_path(self, batch_id: int) -> str:
        return f"{self.path}/journal/batch={batch_id}"

    # --- reading ---

    def batches(self) -> list[int]:
        """The batches in the journal, in order."""
        ids = [int(n.partition("=")[2]) for n in self._listed(f"{self.path}/journal") if n.startswith("batch=")]
        return sorted(i for i in ids if self._complete(self._entry_path(i)))

    def versions(self) -> dict[int, int]:
        """The version of every bucket that has rows: at most one entry a bucket."""
        done = self.batches()
        if not done:
            return {}
        entry = self.spark.read.schema("bucket int, version long").parquet(self._entry_path(done[-1]))
        return {r.bucket: r.version for r in entry.collect()}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        # a path is a bucket, so files of other versions are not even listed
        paths = [f"{self._version_path(v)}/{BUCKET}={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def read(self) -> DataFrame:
        """The table as the last complete merge left it."""
        return self._rows(self.versions())

    # --- merging ---

    def merge(self, batch_id: int, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """`how(stored, rows)` gives the new rows of the buckets that `rows` fall into; False if the batch is already in.

        `stored` holds those buckets only. `rows` need the key columns, and `how` must leave
        at most one row a key.
        """
        done = self.batches()
        if done and batch_id <= done[-1]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # settled: what is read twice must be the same rows, also after a lost executor
        rows = settle(rows)
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}
        versions = self.versions()
        stored = self._rows({b: v for b, v in versions.items() if b in touched})
        merged = how(stored, rows).select(*self.empty.columns).withColumn(BUCKET, bucket)
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._version_path(batch_id))
        left = {int(n.partition("=")[2]) for n in self._listed(self._version_path(batch_id)) if n.startswith(f"{BUCKET}=")}
        now = {b: v for b, v in versions.items() if b not in touched} | {b: batch_id for b in left}
        entry = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long")
        entry.coalesce(1).write.mode("overwrite").parquet(self._entry_path(batch_id))
        return True

    def delete(self, batch_id: int, keys: DataFrame) -> bool:
        """Removes the rows of these keys."""
        return self.merge(batch_id, keys.select(*self.keys).distinct(), lambda stored, gone: stored.join(gone, self.keys, "left_anti"))

    def vacuum(self) -> list[str]:
        """Deletes versions and journal entries that the last one does not need; no reader may still be on them."""
        done, used = self.batches(), set(self.versions().values())
        old = [self._version_path(v) for v in self._numbers("data") if done and v <= done[-1] and v not in used]
        old += [self._entry_path(b) for b in self._numbers("journal") if done and b < done[-1]]
        for path in old:
            fs, where = self._fs(path)
            fs.delete(where, True)
        return old

    def _numbers(self, folder: str) -> list[int]:
        return [int(n.partition("=")[2]) for n in self._listed(f"{self.path}/{folder}") if "=" in n]


def merge_batches(table: StoredTable, prepare: Callable[[DataFrame], DataFrame], how: Callable[[DataFrame, DataFrame], DataFrame]):
    """A foreachBatch function that merges each micro-batch, once however often it comes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch_id, prepare(batch), how)

    return write

"""Skew-proof building blocks: ordered scans over hot keys, and bounded broadcasts.

A plain window puts every row of a key into one task.  `OrderedSlices` splits the
key instead: rows are range-partitioned by (keys, order), so one key spans as many
slices as its size asks for; each slice is scanned on its own and a tiny carry
table joins the slices up again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweir.session import settle

SLICE = "_slice"


class OrderedSlices:
    """A frame cut into ordered slices per key.  `order` must be a total order.

    At most one key can continue from one slice into the next, so every carry table
    holds at most as many rows as there are slices: that bound is what makes its
    broadcast safe whatever the data size.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int | None = None):
        n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys = list(keys)
        self.order = list(order)
        placed = df.repartitionByRange(n, *[F.col(k) for k in self.keys], *self.order)
        self.df = settle(placed.withColumn(SLICE, F.spark_partition_id()))

    def _local(self):
        return Window.partitionBy(SLICE, *self.keys).orderBy(*self.order)

    def _across(self):
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def _attach(self, carry: DataFrame) -> DataFrame:
        carry = carry.where(F.col("_carry").isNotNull())
        renamed = carry.select(
            F.col(SLICE).alias("_c_slice"), *[F.col(k).alias(f"_c_{i}") for i, k in enumerate(self.keys)], "_carry"
        )
        cond = F.col(SLICE) == F.col("_c_slice")
        for i, k in enumerate(self.keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{i}"))
        joined = self.df.join(F.broadcast(renamed), cond, "left")
        return joined.drop("_c_slice", *[f"_c_{i}" for i in range(len(self.keys))])

    def _scan(self, out: str, value: Column, inclusive: bool, agg, merge) -> "OrderedSlices":
        self.df = self.df.withColumn("_value", value)
        totals = self.df.groupBy(SLICE, *self.keys).agg(agg("_value").alias("_total"))
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumn("_carry", agg("_total").over(before)).drop("_total")
        frame = self._local().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = agg("_value").over(frame)
        self.df = self._attach(carry).withColumn(out, merge(local, F.col("_carry"))).drop("_carry", "_value")
        return self

    def running_sum(self, out: str, value: Column, inclusive: bool = True) -> "OrderedSlices":
        return self._scan(
            out, value, inclusive, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        )

    def running_max(self, out: str, value: Column, inclusive: bool = True) -> "OrderedSlices":
        return self._scan(out, value, inclusive, F.max, F.greatest)

    def rank(self, out: str) -> "OrderedSlices":
        return self.running_sum(out, F.lit(1).cast("bigint"))

    def previous(self, out: str, value: Column) -> "OrderedSlices":
        """The value of the row before, across slice borders (lag 1)."""
        self.df = self.df.withColumn("_value", value).withColumn(
            "_tail", F.lead(F.lit(1)).over(self._local()).isNull()
        )
        tails = self.df.where("_tail").select(SLICE, *self.keys, "_value")
        carry = tails.withColumn("_carry", F.lag("_value").over(self._across())).drop("_value")
        head = F.row_number().over(self._local()) == 1
        self.df = (
            self._attach(carry)
            .withColumn(out, F.when(head, F.col("_carry")).otherwise(F.lag("_value").over(self._local())))
            .drop("_carry", "_value", "_tail")
        )
        return self

    def frame(self) -> DataFrame:
        return self.df.drop(SLICE)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key.

    The filter sits straight on row_number, so Spark inserts WindowGroupLimit below the
    exchange: each map task ships at most k rows of a key, however hot the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most max_rows rows; reads no further than one row past it."""
    return df.limit(max_rows + 1).count() <= max_rows

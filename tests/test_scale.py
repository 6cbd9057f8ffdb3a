"""Sliced scans equal plain windows, also when one key holds most rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalweir.scale import OrderedSlices, fits, top_per_key


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("hot" if i % 5 else f"k{i % 35}", (i * 7919) % 1009, i, (i * 31) % 17 - 8) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(5)


def _pandas(df):
    return df.toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)


def test_scans_equal_pandas(skewed):
    scan = OrderedSlices(skewed, ["k"], [F.col("t").asc(), F.col("id").asc()], slices=11)
    assert scan.df.where("k = 'hot'").select("_slice").distinct().count() > 3  # the hot key is spread
    scan.running_sum("s", F.col("v")).running_sum("before", F.col("v"), inclusive=False)
    scan.running_max("m", F.col("v")).rank("n").previous("p", F.col("v"))
    got = _pandas(scan.frame())
    g = got.groupby("k")["v"]
    assert (got["s"] == g.cumsum()).all()
    assert (got["before"] == g.cumsum() - got["v"]).all()
    assert (got["m"] == g.cummax()).all()
    assert (got["n"] == g.cumcount() + 1).all()
    pd.testing.assert_series_equal(got["p"].astype(float), g.shift().astype(float), check_names=False)


def test_slices_do_not_change_the_result(skewed):
    order = [F.col("t").asc(), F.col("id").asc()]
    one = _pandas(OrderedSlices(skewed.repartition(1), ["k"], order, slices=1).running_sum("s", F.col("v")).frame())
    many = _pandas(OrderedSlices(skewed.repartition(7), ["k"], order, slices=13).running_sum("s", F.col("v")).frame())
    pd.testing.assert_frame_equal(one, many[one.columns])


def test_descending_order_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, t long, v long")
    scan = OrderedSlices(df, ["k"], [F.col("t").desc()], slices=4).running_sum("s", F.col("v"))
    assert {(r.k, r.t): r.s for r in scan.frame().collect()} == {(None, 2): 6, (None, 1): 11, ("a", 1): 7}


def test_top_per_key_limits_before_the_exchange(skewed):
    top = top_per_key(skewed, ["k"], [F.col("v").desc(), F.col("id").asc()], 2)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_fits(skewed):
    assert fits(skewed, 3000) and not fits(skewed, 2999)

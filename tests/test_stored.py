"""Stored tables, ledgers beside the streams, bounded state, and the vector index."""

import datetime as dt
import random

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F
from test_state import SIGNALS, T0, _drain, _fed

from signalweir.operators import lifecycle, merge, retrieval, vector_index
from signalweir.registry import QUERIES
from signalweir.registry.base import rounded
from signalweir.registry.views import view
from signalweir.sources.tables import StoredTable
from signalweir.streaming import ledger
from signalweir.streaming.incidents import stream_incidents

COUNTERS = "incident_id string, signal_count long, created long, reopened long"


def _counters(spark, counts):
    return spark.createDataFrame([(k, n, 1, 0) for k, n in counts.items()], COUNTERS)


def _held(table):
    return {r.incident_id: (r.signal_count, r.created) for r in table.read().collect()}


def test_merges_replays_and_interruptions(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path), COUNTERS, ["incident_id"], 4)
    assert table.read().count() == 0 and table.versions() == {}
    first, second = {f"i{n}": n for n in range(20)}, {"i3": 100, "new": 7}
    assert table.merge(0, _counters(spark, first), merge.add_counters)
    assert not table.merge(0, _counters(spark, first), merge.add_counters)

    def breaks(stored, more):
        raise RuntimeError("lost driver")

    with pytest.raises(RuntimeError):
        table.merge(1, _counters(spark, second), breaks)
    # data written, journal not: what an attempt that died in between leaves
    _counters(spark, {"i3": 9}).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{tmp_path}/data/version=1")
    assert _held(table) == {k: (n, 1) for k, n in first.items()}
    again = StoredTable(spark, str(tmp_path), COUNTERS, ["incident_id"], 4)
    assert again.merge(1, _counters(spark, second), merge.add_counters) and not again.merge(0, _counters(spark, second), merge.add_counters)
    want = {k: (n, 1) for k, n in first.items()} | {"i3": (103, 2), "new": (7, 1)}
    assert _held(again) == want and again.batches() == [0, 1]
    untouched = [b for b, v in again.versions().items() if v == 0]
    assert untouched  # buckets without new rows are not rewritten
    assert again.delete(2, spark.createDataFrame([("new",), ("i3",)], "incident_id string"))
    assert _held(again) == {k: v for k, v in want.items() if k not in ("new", "i3")}
    again.vacuum()
    assert _held(again) == {k: v for k, v in want.items() if k not in ("new", "i3")} and again.batches() == [2]


def test_fenced_and_latest_rows_over_stored_batches(spark, tmp_path):
    rows = [(k, v, f"{k}{v}") for k in range(6) for v in range(5)]
    random.Random(3).shuffle(rows)
    table, write = ledger.version_ledger(spark, str(tmp_path), "k long, version long, body string", ["k"], 3)
    for n in range(5):
        write(spark.createDataFrame(rows[6 * n : 6 * n + 6], "k long, version long, body string"), n)
        write(spark.createDataFrame(rows[6 * n : 6 * n + 6], "k long, version long, body string"), n)
    assert sorted(map(tuple, table.read().collect())) == [(k, 4, f"{k}4") for k in range(6)]


def test_late_rows_are_kept_by_the_ledger(spark, tmp_path):
    """Half of each file's rows are hours behind: the stream drops them, the ledger has the batch's incidents."""
    rng = random.Random(6)
    minutes = [rng.random() * 3000 for _ in range(300)]
    late = [m for i, m in enumerate(sorted(minutes)) if i % 5 == 0]
    rest = sorted(set(minutes) - set(late))
    rows = [("t", "hot" if i % 3 else "cold", i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(rest + late)]
    stream = _fed(spark, str(tmp_path / "in"), rows, SIGNALS, 4)
    events = _drain(stream_incidents(stream), tmp_path)
    signals = spark.createDataFrame(rows, SIGNALS)
    dropped = ledger.late_signals(signals, events)
    answered = {r.signal_id for r in events.collect() if r.signal_id is not None}
    assert {r.signal_id for r in dropped.collect()} == {r[2] for r in rows} - answered != set()
    table, write = ledger.block_ledger(spark, str(tmp_path / "ledger"), buckets=3)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ledger-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(table.batches()) == 4
    want = lifecycle.incident_sessions(signals)
    assert sorted(map(tuple, ledger.reconciled_incidents(table).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_hot_key_in_one_batch(spark, tmp_path, monkeypatch):
    rows = [("t", "hot", i, T0 + dt.timedelta(seconds=i * 7 % 90_001)) for i in range(30_000)]
    out = _drain(stream_incidents(_fed(spark, str(tmp_path / "in"), rows, SIGNALS, 1)), tmp_path).where("signal_id IS NOT NULL")
    batch = lifecycle.attach_signals(spark.createDataFrame(rows, SIGNALS))
    columns = ["signal_id", "incident_id", "signal_no", "event_type"]
    assert out.select(*columns).exceptAll(batch.select(*columns)).count() == 0 and out.count() == len(rows)


@pytest.mark.parametrize("name", ["m1_stored_upsert", "t5_late_reconciled", "t11_stream_versions"])
def test_queries_over_more_rows(spark, name):
    from signalweir.registry import ORACLES

    assert compare(QUERIES[name](spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), ORACLES[name]) is None


def test_index_recall(spark):
    """Every hundredth vector against all rows: nine of ten of the exact nearest are found, in a part of the corpus."""
    sf = "/root/testdata/sf0.1"
    chunks = view(spark, sf, "v_chunks").where("embedding IS NOT NULL")
    asked = chunks.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id").withColumn("query_text", F.lit(""))
    exact = retrieval.semantic_search(asked, chunks)
    found = QUERIES["v1_approximate"](spark, sf)
    share = vector_index.recall(found, exact).agg(F.sum("got") / F.sum("wanted")).first()[0]
    assert share >= 0.9
    both = found.join(rounded(exact, "similarity").select("query_id", "chunk_id", F.col("similarity").alias("s")), ["query_id", "chunk_id"])
    assert both.where("abs(similarity - s) > 1e-6").count() == 0
    quantiser = vector_index.fit_quantiser(chunks)
    probed = vector_index.probe(asked, vector_index.index_chunks(chunks, quantiser), quantiser, k=10_000)
    assert probed.count() < 0.8 * retrieval.semantic_search(asked, chunks, 10_000).count()


def test_index_in_blocks(spark, monkeypatch):
    """Questions beyond the broadcast meet the same chunks, and no pair of vectors travels."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 50 == 0 else "tu"[i % 2], "c", rng.normal(size=8).tolist()) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, tenant_id string, collection string, embedding array<double>")
    asked = chunks.where("chunk_id % 10 = 1").withColumnRenamed("chunk_id", "query_id")
    quantiser = vector_index.fit_quantiser(chunks, cells=8)

    def found():
        return vector_index.probe(asked, vector_index.index_chunks(chunks, quantiser), quantiser, probes=4, k=5)

    few = sorted(map(tuple, found().select("query_id", "chunk_id", "rank").collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 4)
    monkeypatch.setattr(retrieval, "BLOCK_ITEMS", 13)
    many = found()
    assert "zip_with" not in many._jdf.queryExecution().toString().lower()
    assert sorted(map(tuple, many.select("query_id", "chunk_id", "rank").collect())) == few and len(few) == 150


def test_index_of_clusters_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, "t", "c", (centres[i % 20] + 0.05 * rng.normal(size=16)).tolist()) for i in range(400)]
    odd = [(900, "t", "c", None), (901, "t", "c", [0.0] * 16), (902, "t", "c", [1.0, 2.0]), (903, "u", "c", centres[0].tolist()), (904, "t", "c", [float("nan")] * 16)]
    kinds = "chunk_id long, tenant_id string, collection string, embedding array<double>"
    chunks = spark.createDataFrame(rows + odd, kinds)
    asked = chunks.where("chunk_id < 40 OR chunk_id > 899").withColumnRenamed("chunk_id", "query_id")
    quantiser = vector_index.fit_quantiser(chunks, cells=40)
    found = vector_index.probe(asked, vector_index.index_chunks(chunks, quantiser, 2), quantiser, probes=4, k=5).collect()
    for q in range(40):
        mine = np.array(rows[q][3]) / np.linalg.norm(rows[q][3])
        sims = [(-float(mine @ (np.array(v) / np.linalg.norm(v))), i) for i, _, _, v in rows]
        assert [r.chunk_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in sorted(sims)[:5]]
    assert {(r.query_id, r.chunk_id) for r in found if r.query_id > 899} == {(903, 903)}
    nothing = chunks.limit(0)
    empty = vector_index.fit_quantiser(nothing)
    assert vector_index.probe(asked, vector_index.index_chunks(nothing, empty), empty).count() == 0

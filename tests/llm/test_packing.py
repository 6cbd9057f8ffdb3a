"""Packing: an exact round trip with the other tokenizer library, limits, padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalweir.llm import queries
from signalweir.llm.packing import Packer, pack, tokenizer


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(pieces, texts, size=2048, max_segments=512):
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size and len(parts) <= max_segments
    t = reference()
    for key, text in texts.items():
        ids, at = [], 0
        for start, piece, n in sorted(docs[key]):
            assert start == at
            ids += piece
            at += len(piece)
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [1] and at == n
    return sum((size if (n := sum(x for _, x in s)) & (n - 1) else n) - n for s in sequences.values())


def test_round_trip_and_padding(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert check(pack(documents.repartition(3, "doc_id"), queries.VOCABULARY, added=queries.ADDED).collect(), texts) == 0


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "a \nb c", "a\n \nb", "x y z", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "a  \n<|endoftext|>  b", "<|endoftext|", "don't 12 3!? \t x", "日本 語", "a\x1cb \x1c c"])
def test_chunks_equal_the_whole(text):
    got = np.frombuffer(tokenizer(queries.VOCABULARY, queries.ADDED)(text), "<u4").tolist()
    assert got == reference().encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(pack(rows, queries.VOCABULARY, added=queries.ADDED, size=64, max_segments=4).collect(), {r.doc_id: r.text for r in rows.collect()}, 64, 4)
    assert pack(awkward, queries.VOCABULARY, added=queries.ADDED).where("start = 0").count() == awkward.count()
    assert pack(nothing, queries.VOCABULARY, added=queries.ADDED).collect() == []


def test_limits_hold_together():
    rng = np.random.default_rng(1)
    packer = Packer(64, 5, 20, 0)
    rows, loss = [], {}
    for key in range(300):
        n = int(rng.integers(1, 150))
        loss[key] = rng.random(n) < rng.random()
        ids = np.arange(n, dtype="<u4").tobytes()
        rows += packer.add((key, n), ids, loss[key])
    rows += packer.close()
    used, seen = defaultdict(lambda: np.zeros(3, int)), defaultdict(list)
    for (key, n), start, ids, sequence, offset in rows:
        k = len(ids) // 4
        assert used[sequence][0] == offset
        used[sequence] += (k, 1, loss[key][start : start + k].sum())
        seen[key] += np.frombuffer(ids, "<u4").tolist()
    assert all((u <= (64, 5, 20)).all() for u in used.values())
    assert all(sorted(seen[k]) == list(range(len(loss[k]))) for k in loss)


def test_loss_column(spark):
    rows = spark.createDataFrame([(i, "some words of a turn " * 20, i % 2 == 0) for i in range(40)], "doc_id long, text string, bears boolean")
    got = pack(rows.coalesce(1), queries.VOCABULARY, loss_col="bears", size=256, max_loss=64).toPandas()
    assert (got[got.id % 2 == 0].groupby("sequence_id").length.sum() <= 64).all()


def test_segments_that_run_out_leave_no_padding(spark):
    rows = spark.createDataFrame([(i, "ab cd") for i in range(3000)], "doc_id long, text string").coalesce(1)
    assert check(pack(rows, queries.VOCABULARY, added=queries.ADDED).collect(), dict.fromkeys(range(3000), "ab cd")) == 0
    rows = spark.createDataFrame([(i, "ab cd <|endoftext|>" * (1 + i % 9)) for i in range(500)], "doc_id long, text string").coalesce(1)
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert check(pack(rows, queries.VOCABULARY, added=queries.ADDED, size=256, max_segments=7).collect(), texts, 256, 7) == 0


def test_a_full_pool_stays_within_its_bound():
    packer, rows = Packer(64, 5, 20, 0), []
    packer.POOL = 16
    for key in range(400):
        rows += packer.add((key, 9), np.arange(9, dtype="<u4").tobytes(), np.arange(9) % 2 < key % 3)
        assert len(packer.pool) <= 16
    rows += packer.close()
    sizes = defaultdict(int)
    for _, _, ids, sequence, _ in rows:
        sizes[sequence] += len(ids) // 4
    assert sum(sizes.values()) == 3600 and all(n & (n - 1) == 0 for n in sizes.values())


def test_limits_must_be_positive(spark, nothing):
    with pytest.raises(ValueError):
        pack(nothing, queries.VOCABULARY, max_loss=0)


def test_query_digest(spark):
    rows = queries.op1_packing(spark, "/root/testdata/sf0.001").where("start = 0").limit(20).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        ids = reference().encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[: r.length], "<u4").tobytes())

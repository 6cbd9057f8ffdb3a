"""Decontamination against a brute-force scan."""

import hashlib
import re

import pytest

from signalweir.llm import queries
from signalweir.llm.decontaminate import cut_contaminated, drop_contaminated, hit_items, hit_words, with_spans

SF = "/root/testdata/sf0.01"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        if not n:
            continue
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_query_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_decontamination(spark, SF).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        n, hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short Item"), (3, ""), (4, None), (None, "left out"), (5, "one")]
TEXTS = [
    (1, "zero one two three four five six seven eight nine ten eleven twelve x short ITEM end"),
    (2, "short, item! short item"), (3, None), (4, ""), (5, "One"), (6, "two three four five six seven eight nine ten"), (6, "two three"),
]


@pytest.mark.parametrize("part", [1 << 20, 8])
def test_lengths_and_parts(spark, part):
    docs = spark.createDataFrame([(*t, "z") for t in TEXTS], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = with_spans(docs, items, out="c", part_windows=part)
    rows = got.select("doc_id", "text", "c.n_words", hit_words(got.c.spans).alias("h"), hit_items(got.c.spans).alias("i")).collect()
    known = [i for i in ITEMS if i[0] is not None]
    for r in rows:
        assert (r.n_words, r.h, sorted(r.i)) == brute(r.text, known)
    assert len(rows) == len(TEXTS)


def test_drop_and_cut(spark, awkward, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [3, 4, 6, 6]
    cut = {r.doc_id: r.text for r in cut_contaminated(docs, items).where("doc_id < 4").collect()}
    assert cut == {1: "zero  x  end", 2: "! ", 3: None} or cut[1].split() == ["zero", "x", "end"]
    assert drop_contaminated(awkward, items).columns == awkward.columns
    assert drop_contaminated(awkward, items).count() == awkward.count()
    assert drop_contaminated(nothing, items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == len(TEXTS)


@pytest.mark.parametrize("part_windows", [1 << 20, 4])
def test_clashing_names_stay(spark, part_windows):
    docs = spark.createDataFrame([(1, "no such words", 7, "a", "b"), (2, ITEMS[0][1], 8, "c", "d")], "doc_id long, text string, _more_spans int, _contamination string, _MORE string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = with_spans(docs, items, part_windows=part_windows)
    assert found.columns == [*docs.columns, "contamination"] and {r._more_spans for r in found.collect()} == {7, 8}
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "no such words", 7, "a", "b")]

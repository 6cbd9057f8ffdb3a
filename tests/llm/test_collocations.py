"""Collocations against plain counting, also where fingerprints collide and blocks are short."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from signalweir.llm import collocations as co
from signalweir.llm import queries

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def ranked(rows, longest=3, min_count=10, share=50, k=2000):
    f, n = counted(rows, longest)
    often = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    longer = defaultdict(int)
    for (lang, words), a in often.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = lang, words[i : i + size]
                longer[key] = max(longer[key], a)
    by_lang = defaultdict(list)
    for (lang, words), a in often.items():
        cuts = []
        for i in range(1, len(words)):
            left, right = f[lang, words[:i]], f[lang, words[i:]]
            cuts.append((10**6 * a * a // (left * right), i, left, right))
        score, _, left, right = min(cuts)
        if 100 * longer[lang, words] < share * a or not longer[lang, words]:
            by_lang[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:k], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def test_query_equals_counting(spark, documents):
    want = ranked([(r.lang, r.text) for r in documents.collect()])
    found = got(queries.QUERIES["op13_collocations"](spark, SF))
    assert found == want and len(found) > 100


@pytest.fixture
def short(monkeypatch):
    """Blocks, slices and buckets so small that every border is met."""
    monkeypatch.setattr(co, "BLOCK_WORDS", 50)
    monkeypatch.setattr(co, "SLICE_BYTES", 64)
    monkeypatch.setattr(co, "BUCKET_BYTES", 1 << 12)


@pytest.mark.parametrize("weak", [64, 12, 3])
def test_collisions_and_borders(spark, short, weak):
    rng = np.random.default_rng(weak)
    words = ["Alpha", "beta", "béta", "日本", "x" * 90, "gamma", "delta", "a", "\x01b"]
    seps = [" ", "  ", " \t", ". ", "\n", "; ", " "]
    rows = [
        (["en", "de", None, "und"][rng.integers(4)], "".join(words[rng.integers(9)] + seps[rng.integers(7)] for _ in range(rng.integers(120))))
        for _ in range(80)
    ]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert got(co.collocations(docs, min_count=5, longest=4, weak=weak)) == ranked(rows, 4, 5)


def test_words_that_share_a_hash_are_told_apart():
    grams = co.Grams(weak=2)
    for _ in grams.add("en", b"one two three four five six one two seven two"):
        pass
    grams.close()
    grams.name_words()
    words = "one two three four five six one two seven two".split()
    assert [grams.word[i] == grams.word[j] for i in range(10) for j in range(10)] == [a == b for a in words for b in words]
    found = Counter()
    for n in (1, 2):
        for at, m in grams.exact(*grams.grams(n), n):
            found[grams.phrase(at, n)] += m
    assert found == Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


@pytest.mark.parametrize("buckets", [0, 1, 8, 20])
def test_prints_are_sent_in_few_bytes(buckets):
    rng = np.random.default_rng(buckets)
    bucket = (1 << buckets) - 1
    prints = np.sort(rng.integers(0, 1 << 63, 2000, np.uint64) << np.uint64(1) >> np.uint64(buckets)) | np.uint64(bucket << (64 - buckets) if buckets else 0)
    data = co._short(prints, buckets)
    back = co._long(data, bucket, buckets)
    lost = np.uint64(64 - max(co.SIEVE_BITS, buckets + 24))
    assert (back == prints >> lost << lost).all()
    assert len(pa.compress(data, codec="lz4", asbytes=True)) < (3.5 if buckets < 2 else 2.5) * len(prints)


def test_languages_of_any_name(spark):
    rows = [(lang, "a b c. a b") for lang in ("x\ny", "x", "", "x\n", "und", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(co.collocations(docs, min_count=2)) == ranked(rows, 3, 2)
    phrases, totals = co.frequent_phrases(docs, min_count=1)
    f, n = counted(rows)
    assert {(r.lang, r.words, r.phrase): r.f for r in phrases.collect()} == {(lang, len(w), " ".join(w)): m for (lang, w), m in f.items()}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    table = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    phrases = spark.createDataFrame(table, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(co, "frequent_phrases", lambda *a: (phrases, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
    (row,) = co.collocations(phrases).collect()
    assert row.score == 10**6 * (big - 1) ** 2 // big**2 and (row.a, row.l, row.r) == (big - 1, big, big)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert got(co.collocations(awkward, min_count=2)) == ranked(rows, 3, 2)
    clashing = awkward.withColumnsRenamed({"doc_id": "phrase", "source": "words", "n_chars": "f"})
    assert got(co.collocations(clashing, min_count=2)) == ranked(rows, 3, 2)
    assert co.collocations(nothing).count() == 0

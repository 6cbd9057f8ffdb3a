"""Toxicity and language: accuracy on rows that nothing was learned from, planted cases, awkward rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweir.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"
INSULTS = ["idiot", "loser", "stupid", "moron"]
HIDDEN = [
    "you l0ser", "a $tupid thing", "such an 1d1ot", "m 0 r 0 n that is", "s.t.u.p.i.d words", "what a looooser",
    "an i d i o t said it", "st*upid talk here", "IDIOT", "mor0n!",
]


@pytest.fixture(scope="module")
def taught(spark):
    """Invented sentences with insults in one in five, and labels for them."""
    rng = np.random.default_rng(2)
    words = ["river", "stone", "table", "window", "story", "garden", "idea", "lost", "student", "moral", "studio", "idiom", "more", "close"]
    rows, marks = [], []
    for key in range(1500):
        text = list(rng.choice(words, int(rng.integers(5, 60))))
        if bad := key % 5 == 0:
            text.insert(int(rng.integers(len(text))), INSULTS[key // 5 % 4])
        rows.append((key, " ".join(text)))
        marks.append((key, int(bad)))
    rows += [(9000, None), (9001, "")]
    marks += [(9000, 1), (9001, 0), (9002, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))


def test_restores_disguised_words(spark, taught):
    _, model = taught
    assert {f for f in model["weights"]} == {"=" + w for w in INSULTS}
    rows = [(i, t) for i, t in enumerate(HIDDEN)] + [(100 + i, t) for i, t in enumerate(["room 101 is open", "a b c d e", "call +1 (658) 555-4270", "student idiom more", "mail me@site.com"])]
    got = {r.id: r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {k: s >= 0.5 for k, s in got.items()} == {k: k < 100 for k, _ in rows}


def test_separators_may_be_word_edges_and_no_stretch_is_too_long(spark, taught):
    _, model = taught
    bad, other = INSULTS[0], INSULTS[1]
    apart = " ".join
    rows = [
        f"the stone a {apart(bad)} river", f"the.stone.{bad[:2]}{bad[2:].replace('i', '1').replace('o', '0')}.x1", f"lost-{bad[0]}*{bad[1:]}",
        bad[0] + bad[1] * 45 + bad[2:], f"{apart(bad)} {apart(other)}", apart("river stone table window story garden ".replace(" ", "") * 3) + " " + apart(bad),
        "river." * 400 + bad[:-1] + "_" + bad[-1],
    ]
    got = toxicity.scored(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).collect()
    assert {r.id: r.score >= 0.5 for r in got} == dict.fromkeys(range(len(rows)), True)


def test_viterbi_equals_all_paths(taught):
    channel = taught[1]["channel"]

    def price(word: str) -> float:
        cost, x, y = 0.0, 0, 0
        for c in word:
            k = toxicity._index(c)
            cost += float(channel.start[k] if y == 0 else channel.cost[x, y, k])
            x, y = y, k
        return cost + float(channel.cost[x, y, 0])

    for stretch in ["st0ry", "1d10m", "m.o.r.e", "l 0 s t", "s__t", "cl00se", "a!1|b", "m..e"]:
        best: dict[str, float] = {}
        for path in itertools.product(*channel.lattice(stretch)):
            text = " ".join("".join(x for x, _ in path).split())
            if text:
                best[text] = min(best.get(text, 1e9), sum(p for _, p in path) + sum(map(price, text.split())))
        got = channel.readings(stretch)
        assert len(got) == min(len(best), toxicity.READINGS) == len(set(got))
        assert np.allclose([best[g] for g in got], sorted(best.values())[: len(got)], atol=1e-4), stretch


def test_clashing_names_stay(spark, taught):
    docs = taught[0].limit(20).withColumn("_toxicity", F.lit("mine")).withColumn("__TOXICITY", F.lit(2))
    kept = toxicity.drop_toxic(docs, taught[1])
    assert kept.columns == docs.columns and {(r._toxicity, r["__TOXICITY"]) for r in kept.collect()} == {("mine", 2)}


def test_toxic_awkward(spark, taught, awkward, nothing):
    docs, model = taught
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in range(1500) if k % 5} | {9000, 9001}
    scores = toxicity.scored(awkward, model).collect()
    assert len(scores) == awkward.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(nothing, model).count() == 0
    blank = toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.scored(awkward, blank).collect())


def test_toxicity_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"  # sf0.01 has four such rows in English
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    found = queries.op6_toxicity(spark, d).where("held_out").join(labels, "doc_id").join(docs, "doc_id").toPandas()
    assert (found[found.toxic == 0].predicted == 0).mean() >= 0.99
    # other languages have toxic labels there that nothing in the texts explains
    assert (found[(found.toxic == 1) & (found.lang == "en")].predicted == 1).mean() >= 0.85


def test_language_query_on_held_out_rows(spark):
    got = queries.op8_language_id(spark, SF).where("held_out")
    found = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 100 and (found.lang == found.lang_pred).mean() >= 0.95
    sure = found[~found.rejected]
    assert len(sure) >= 0.8 * len(found) and (sure.lang == sure.lang_pred).mean() >= 0.97


def test_language_awkward(spark, awkward, nothing, documents):
    model = language_id.fit(documents)
    got = language_id.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r.lang == "und") == (r.id in (3, 4, 5, 6) or r.score == 0) and 0 <= r.score <= 1
    empty = language_id.fit(nothing)
    assert {r.lang for r in language_id.identify(awkward, empty).collect()} == {"und"}
    odd = language_id.fit(awkward.unionByName(documents.limit(0).select("*", F.lit("").alias("_row"))))
    assert set(odd["names"]) <= {"en", "de", "fr"}
    assert language_id.identify(nothing, model).count() == 0


def test_bucket_stretches_agree():
    data = ("lorem ipsum dolor " * 40_000).encode()
    whole = np.concatenate(list(language_id.buckets_of(data)))
    size, language_id.CHUNK = language_id.CHUNK, 1000
    try:
        cut = np.concatenate(list(language_id.buckets_of(data)))
    finally:
        language_id.CHUNK = size
    assert np.array_equal(np.bincount(whole, minlength=1 << 15), np.bincount(cut, minlength=1 << 15))

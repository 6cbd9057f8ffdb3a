"""The pipeline, each stage held to its own input."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_subsets(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == stages[0].columns
        assert after.exceptAll(before).count() == 0


def test_decisions(stages):
    docs, clean, exact, near, safe, packed = [s.collect() for s in stages]
    assert 0 < len(docs) - len(clean) < 0.2 * len(docs)
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in clean]
    assert len(exact) == len(set(squeezed))
    assert 0 < len(exact) - len(near) < 0.3 * len(exact)
    assert len(safe) < len(near)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(x.ids) + 1 for x in t.encode_batch([r.text or "" for r in safe], add_special_tokens=False))
    assert sum(r.length for r in packed) == total and {r.doc_id for r in packed} == {r.doc_id for r in safe}


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == stages[-1].count()


def test_awkward_rows(spark, awkward):
    docs = awkward.drop("_row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.count() >= 6
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == docs.count()


def test_empty_table(spark, nothing):
    docs = nothing.drop("_row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert docs.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_near_stage_takes_the_links_of_fingerprints(spark, monkeypatch):
    """The trees see every distinct SimHash, find the near copies, and what they link is verified on the sets."""
    from signalweir.llm import near_dedup

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "z"]), "same " * 400 + "a b c", "same " * 400 + "x y z", "far from all of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, pairs = [], near_dedup.fingerprint_pairs

    def spied(base, distinct, *rest):
        ids = {r._row: r.id for r in base.collect()}
        found = pairs(base, distinct, *rest)
        seen.append({(ids[r.a], ids[r.b]) for r in found.collect()})
        return found

    monkeypatch.setattr(near_dedup, "fingerprint_pairs", spied)
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()}
    assert [{tuple(sorted(p)) for p in s} for s in seen] == [{(0, 1), (2, 3)}] and kept == {0, 2, 3, 4}

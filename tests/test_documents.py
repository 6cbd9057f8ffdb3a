import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalweir.operators import documents, retrieval
from signalweir.sources.documents import accept_documents, read_documents


def _docs(spark, *texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "document_id long, content string")


def _chunks(spark, text, **kw):
    return documents.chunk_documents(_docs(spark, text), **kw).orderBy("chunk_index").collect()


def test_empty_documents_have_no_chunks(spark):
    assert documents.chunk_documents(_docs(spark, "", "   \n  ", None)).count() == 0


def test_small_document_and_heading_trail(spark):
    (c,) = _chunks(spark, "# Database Runbook\n\nRestart the primary with pg_ctl restart.")
    assert (c.chunk_index, c.heading) == (0, "Database Runbook")
    assert c.content == "[Database Runbook]\nRestart the primary with pg_ctl restart."
    assert c.token_estimate == math.ceil(len(c.content) / 4)
    (deep,) = _chunks(spark, "# Runbooks\r\n\r\n## Database\n\n### Failover\n\nPromote the replica.")
    assert deep.heading == "Runbooks > Database > Failover"


def test_sections_leave_a_level_when_a_higher_one_opens(spark):
    text = "intro\n# A\na\n### C\nc\n## B\nb\n#no heading\n####### seven\n# D\n"
    got = documents.markdown_sections(_docs(spark, text)).orderBy("section_index").collect()
    assert [(r.heading, r.content) for r in got] == [
        ("", "intro"), ("A", "a"), ("A > C", "c"), ("A > B", "b\n#no heading\n####### seven")
    ]


@pytest.mark.parametrize(
    "body, limit, overlap, scrap, want",
    [
        ("aaaa bbbb cccc\n\ndddd eeee ffff", 20, 5, 3, ["aaaa bbbb cccc", " cccc\n\ndddd eeee ffff"]),
        ("aaa bbb ccc ddd", 10, 0, 3, ["aaa bbb", "ccc ddd"]),
        ("aaaa bbbb\n\ncc", 10, 0, 5, ["aaaa bbbb\n\ncc"]),
        ("aaaa\n\n\n  bbbb  \n\ncc", 14, 0, 1, ["aaaa\n\nbbbb\n\ncc"]),
        ("a" * 24, 10, 4, 1, ["a" * 10, "aaaa", "aaaa\naaaaa", "aaaa", "aaaa\n\n" + "a" * 9]),
    ],
)
def test_packing(spark, body, limit, overlap, scrap, want):
    got = _chunks(spark, body, max_chars=limit, overlap=overlap, min_chars=scrap)
    assert [c.content for c in got] == want


@pytest.mark.parametrize("limit, overlap", [(300, 0), (300, 40), (1200, 200)])
def test_packing_loses_nothing(spark, limit, overlap):
    rng = random.Random(limit)
    texts = [
        "\n\n".join(
            " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 300))) for _ in range(rng.randint(1, 6))
        )
        for _ in range(20)
    ]
    rows = documents.chunk_documents(_docs(spark, *texts), limit, overlap, 1).collect()
    for n, text in enumerate(texts):
        got = [r.content for r in sorted((r for r in rows if r.document_id == n), key=lambda r: r.chunk_index)]
        fresh = got[:1] + [after.removeprefix(before[len(before) - overlap :] if overlap else "") for before, after in zip(got, got[1:])]
        assert all(len(c) <= limit + overlap + 2 for c in got)
        assert re.findall(r"w\d+", " ".join(fresh)) == text.split()


def test_hard_split_and_bad_overlap(spark):
    assert [len(c.content) for c in _chunks(spark, "x" * 500, max_chars=100, overlap=0)] == [100] * 5
    with pytest.raises(ValueError):
        documents.chunk_documents(_docs(spark, "hi"), 100, 100)


# --- change detection ---


def _arrivals(spark, *rows):
    full = [("t", "c", uri, text, n) for n, (uri, text) in enumerate(rows)]
    return spark.createDataFrame(full, "tenant_id string, collection string, source_uri string, content string, arrival long")


def _verdicts(df):
    return [(r.action, r.version) for r in df.orderBy("arrival").collect()]


def test_changes_follow_the_path(spark):
    got = _verdicts(documents.document_changes(_arrivals(spark, ("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("a", "x"))))
    assert got == [("created", 1), ("unchanged", 1), ("updated", 2), ("created", 1), ("updated", 3)]


def test_anonymous_documents_meet_what_is_there_at_that_moment(spark):
    rows = [(None, "x"), (None, "x"), ("a", "p"), (None, "p"), ("a", "q"), (None, "p"), (None, "p"), (None, "q")]
    got = _verdicts(documents.document_changes(_arrivals(spark, *rows)))
    assert [a for a, _ in got] == [
        "created", "unchanged", "created", "unchanged", "updated", "created", "unchanged", "unchanged"
    ]


def test_changes_against_a_stored_table(spark):
    first = documents.document_changes(_arrivals(spark, ("a", "x"), (None, "z")))
    empty = first.limit(0).select(
        "tenant_id", "collection", "source_uri", "content", "content_hash", "version", F.lit("ready").alias("status")
    )
    stored = documents.apply_changes(empty, first)
    got = documents.document_changes(_arrivals(spark, ("a", "x"), ("a", "y"), (None, "z"), (None, "x"), (None, "w")), stored)
    assert _verdicts(got) == [("unchanged", 1), ("updated", 2), ("unchanged", 1), ("created", 1), ("created", 1)]
    after = documents.apply_changes(stored, got)
    assert sorted((r.source_uri or "-", r.version, r.content) for r in after.collect()) == [
        ("-", 1, "w"), ("-", 1, "x"), ("-", 1, "z"), ("a", 2, "y")
    ]


def test_purge_and_reload(spark):
    live = spark.createDataFrame([(1, 0, "old1", [1.0]), (2, 0, "old2", [1.0])], "document_id long, chunk_index long, content string, embedding array<float>")
    fresh = spark.createDataFrame(
        [(1, 1, 0, "stale", [1.0]), (1, 2, 0, "new", [1.0]), (1, 2, 1, "new2", None), (2, 1, 0, "lost", None)],
        "document_id long, version long, chunk_index long, content string, embedding array<float>",
    )
    versions = spark.createDataFrame([(1, 2), (2, 1)], "document_id long, version long")
    got = documents.install_chunks(live, fresh, versions)
    assert sorted(r.content for r in got.collect()) == ["new", "new2", "old2"]


def test_document_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "b.md").write_text("  \n ")
    ok, bad = accept_documents(read_documents(spark, str(tmp_path)))
    assert [(r.title, r.content) for r in ok.collect()] == [("a.md", "# A\n\ntext")]
    assert [(r.source_uri, r.reject_reason) for r in bad.collect()] == [("b.md", "empty")]


# --- retrieval ---

QUERY = "database connection pool exhausted"


def _rerank(spark, candidates, **kw):
    q = spark.createDataFrame([(1, QUERY)], "query_id long, query_text string")
    rows = [(1, c[0], c[1], c[2], n + 1) for n, c in enumerate(candidates)]
    c = spark.createDataFrame(rows, "query_id long, chunk_id string, content string, similarity double, rank long")
    return retrieval.mmr_rerank(q, c, **kw).orderBy("position").collect()


def test_lexical_match_beats_a_vague_one(spark):
    got = _rerank(
        spark,
        [("vague", "the system experienced degraded performance", 0.80), ("exact", "database connection pool exhausted; raise max_connections", 0.78)],
        k=2, alpha=0.5,
    )
    assert [r.chunk_id for r in got] == ["exact", "vague"] and got[0].lexical > got[1].lexical


def test_mmr_prefers_the_diverse_chunk(spark):
    dup = "database connection pool exhausted raise max_connections now"
    got = _rerank(
        spark, [("a", dup, 0.90), ("b", dup + " please", 0.89), ("c", "failover to the standby replica using repmgr promote", 0.70)], k=2, lam=0.5
    )
    assert [r.chunk_id for r in got] == ["a", "c"]


def test_never_more_than_k_and_short_pools(spark):
    assert len(_rerank(spark, [(str(i), f"chunk {i} pool connection", 0.5 + i / 100) for i in range(10)], k=3)) == 3
    assert len(_rerank(spark, [("a", "x", 0.1)], k=3)) == 1


def test_fusion(spark):
    lists = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "c"), (1, 1, 1, "c"), (1, 1, 2, "b"), (1, 1, 3, "d"), (1, 1, 4, None)]
    ranked = spark.createDataFrame(lists, "query_id long, list_no int, rank long, chunk_id string")
    got = {r.chunk_id: r for r in retrieval.fused_top(retrieval.reciprocal_rank_fusion(ranked)).collect()}
    assert set(got) == set("abcd")
    assert got["b"].rank < got["a"].rank and got["c"].rank < got["d"].rank
    assert got["c"].rrf == pytest.approx(1 / 62 + 1 / 60)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    words = ["pool", "db", "a_b", "timeout", "kafka", "x.y", "axb"]
    chunks = [(i, "t" if i % 3 else "u", "c", " ".join(rng.choice(words) for _ in range(4)).upper(), vec() if i % 10 else None) for i in range(200)]
    questions = [(q, "t" if q % 4 else "u", "c", " ".join(rng.choice(words) for _ in range(3)), vec()) for q in range(30)]
    return (
        spark.createDataFrame(questions, "query_id long, tenant_id string, collection string, query_text string, embedding array<float>"),
        spark.createDataFrame(chunks, "chunk_id long, tenant_id string, collection string, content string, embedding array<float>"),
    )


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("search", [retrieval.semantic_search, retrieval.keyword_search])
def test_blocked_search_equals_broadcast_search(corpus, monkeypatch, search):
    few = _rows(search(*corpus, 7))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 4)
    monkeypatch.setattr(retrieval, "BLOCK_ITEMS", 13)
    assert _rows(search(*corpus, 7)) == few and few


def test_keyword_wildcards(spark):
    q = spark.createDataFrame([(1, "t", "c", "a_b")], "query_id long, tenant_id string, collection string, query_text string")
    c = spark.createDataFrame([(1, "t", "c", "AXB"), (2, "t", "c", "ab"), (3, "u", "c", "a_b")], "chunk_id long, tenant_id string, collection string, content string")
    assert [(r.chunk_id, r.hits) for r in retrieval.keyword_search(q, c).collect()] == [(1, 1)]


def test_similar_incidents_skip_self_then_apply_the_floor(spark):
    rows = [("t", 1, [1.0, 0.0]), ("t", 2, [1.0, 0.0]), ("t", 3, [0.8, 0.6]), ("t", 4, [0.0, 1.0]), ("u", 5, [1.0, 0.0]), ("t", 6, None)]
    memory = spark.createDataFrame(rows, "tenant_id string, incident_id long, embedding array<float>")
    got = retrieval.similar_incidents(memory, memory, k=2).collect()
    assert {(r.incident_id, r.similar_incident_id) for r in got} == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)}


def test_context_budget(spark):
    chunks = spark.createDataFrame(
        [(1, 10, "T", "H", "x" * 50), (2, 20, "T", None, "y" * 50), (3, 30, None, None, "z")], "chunk_id long, document_id long, title string, heading string, content string"
    )
    hits = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 3, 0.7), (2, 3, 1, 0.2)], "query_id long, chunk_id long, position long, score double")
    blocks = retrieval.cited_blocks(hits, chunks, max_chars=70)
    assert [r.context for r in retrieval.pack_context(blocks).collect()] == ["[[1]] T › H\n" + "x" * 50]
    wide = retrieval.pack_context(retrieval.cited_blocks(hits, chunks)).first()
    assert wide.sources == 3 and wide.context.endswith("[[3]] untitled\nz")


def test_similar_incidents_of_many_rows(spark, monkeypatch):
    """More incidents than are broadcast, asked of their own table; a row without a tenant meets nothing."""
    rng = random.Random(9)
    rows = [("t" if i % 3 else "u", i, [abs(rng.gauss(0, 1)) for _ in range(4)]) for i in range(120)]
    rows += [(None, 500, [1.0] * 4), (None, 501, [1.0] * 4)]
    memory = spark.createDataFrame(rows, "tenant_id string, incident_id long, embedding array<double>")
    few = _rows(retrieval.similar_incidents(memory, memory))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 4)
    monkeypatch.setattr(retrieval, "BLOCK_ITEMS", 13)
    got = retrieval.similar_incidents(memory, memory)
    assert _rows(got) == few and {r[0] for r in few} == set(range(120))


def test_equal_vectors_have_equal_cosines():
    """The smaller id comes first wherever the copies lie."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 37))
    items = pd.DataFrame({"item_id": np.arange(400)[::-1], "payload": [vectors[i % 40] for i in range(400)]})
    asked = pd.DataFrame({"query_id": np.arange(40), "payload": list(rng.normal(size=(40, 37)))})
    found = retrieval.cosine_scorer()(asked, items, 10)
    assert all(sorted(part["item_id"]) == part["item_id"].tolist() for _, part in found.groupby("query_id"))
    assert (found.groupby("query_id")["score"].nunique() == 1).all()


def test_keyword_counts_of_an_item_lie_together(monkeypatch):
    """Every term of every text adds to all its askers: they must be neighbours, or each is a cache miss."""
    seen = []
    best = retrieval._best
    monkeypatch.setattr(retrieval, "_best", lambda scores, k, floor: seen.append(scores) or best(scores, k, floor))
    asked = [["pool", "a_b", "50%"], [], ["pool", "disk"], ["zzz"]] * 3
    texts = ["Pool axb 501", "disk pool pool", "nothing", ""]
    queries = pd.DataFrame({"query_id": range(12), "payload": asked})
    out = retrieval._keyword_score(queries, pd.DataFrame({"item_id": [7, 5, 3, 1], "payload": texts}), 2)
    assert seen[0].shape == (12, 4) and seen[0].T.flags.c_contiguous
    want = {(n, 7): 3.0 for n in (0, 4, 8)} | {(n, 5): 1.0 for n in (0, 4, 8)} | {(n, 5): 2.0 for n in (2, 6, 10)} | {(n, 7): 1.0 for n in (2, 6, 10)}
    assert {(q, i): s for q, i, s in out.itertuples(index=False)} == want

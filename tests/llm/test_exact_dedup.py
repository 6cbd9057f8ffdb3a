"""Exact dedup against a dictionary; SQL is held against it too."""

import re

import pytest
from oracle import compare, duck

from signalweir.llm import queries
from signalweir.llm.exact_dedup import drop_exact, exact_groups


def brute(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, i))
    return groups


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert compare(queries.op4_exact_dedup(spark, d), duck(d), queries.ORACLES["op4_exact_dedup"]) is None


@pytest.mark.parametrize("first,growth", [(64, 16), (1, 2), (3, 5)])
def test_levels(spark, first, growth):
    body = "abcdefgh" * 20
    rows = [(i, body[: 20 + i % 7 * 20] + tail) for i in range(40) for tail in ("", " ", "x", "xy")] + [(900 + i, "ab" * i) for i in range(5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_groups(df, first=first, growth=growth).collect()
    groups = brute(rows)
    keep = {k: min(v)[2] for v in groups.values() for *_, k, _ in v}
    size = {k: len(v) for v in groups.values() for *_, k, _ in v}
    assert len(got) == len(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, set()).add(re.sub(r"\s", "", t))
    for r in got:
        if len(texts[r.id]) == 1:
            assert (r.keep_id, r.group_size) == (keep[r.id], size[r.id])
    assert sum(r.kept for r in got) == len(groups)


def test_awkward_rows(spark, awkward, nothing):
    got = exact_groups(awkward).collect()
    assert sum(r.kept for r in got) == 6 and len(got) == awkward.count()
    assert {r.keep_id for r in got if r.id in (1, 2)} == {2}  # a space more
    assert {r.keep_id for r in got if r.id in (3, 4, 5)} == {5}  # the most code points
    assert exact_groups(nothing).count() == 0
    kept = drop_exact(awkward)
    assert kept.columns == awkward.columns and kept.count() == 6

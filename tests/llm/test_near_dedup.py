"""SimHash, vantage-point links and components against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from signalweir.llm import near_dedup, queries
from signalweir.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(points, radius):
    """Component of each point by all pairs."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]).sum(1) <= radius)
        for j in near:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(points))]


def brute(rows, size=4, radius=4):
    fps = {k: simhash(t, size) for k, t in rows}
    keys = sorted(fps)
    roots = grouped(np.array([[fps[k]] for k in keys], np.uint64), radius)
    return {k: (f"{fps[k]:016x}", keys[r]) for k, r in zip(keys, roots)}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def clusters(rng, n, spread, words=1):
    centres = rng.integers(0, 1 << 63, (6, words), dtype=np.uint64)
    points = centres[rng.integers(0, 6, n)]
    for _ in range(spread):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, (n, words), dtype=np.uint64))
    return np.unique(np.concatenate([points, rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)]), axis=0)


@pytest.mark.parametrize("n,spread", [(5, 1), (300, 1), (400, 3), (400, 6), (900, 9)])
def test_tree_links_equal_all_pairs(n, spread):
    points = clusters(np.random.default_rng(n + spread), n, spread)
    member, root = near_dedup.links_within(points, 4)
    label = np.arange(len(points))
    label[member] = root
    assert label.tolist() == grouped(points, 4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=200, unique=True), st.integers(0, 4))
def test_tree_on_dense_points(values, radius):
    points = np.array(values, np.uint64)[:, None]
    member, root = near_dedup.links_within(points, radius)
    label = np.arange(len(points))
    label[member] = root
    assert label.tolist() == grouped(points, radius)


@pytest.mark.parametrize("limit", [1 << 16, 7])
def test_masks_and_blocks_lose_no_link(spark, limit):
    points = clusters(np.random.default_rng(3), 400, 4)
    fps = [int(p[0]).to_bytes(8, "big") for p in points]
    distinct = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    links = near_dedup.near_links(distinct, 64, 4, 5, 13, limit)
    found = {bytes(r.node): bytes(r.root) for r in components(links).collect()}
    got = defaultdict(set)
    for f in fps:
        got[found.get(f, f)].add(f)
    want = defaultdict(set)
    for f, r in zip(fps, grouped(points, 4)):
        want[r].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1
    assert len(got) == 501 and got[0] != got[1000]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark, awkward, nothing):
    rows = near_dedup.near_groups(awkward).collect()
    assert len(rows) == awkward.count()
    blank = {r.component_id for r in rows if not any(bytes(r.fp))}
    assert blank == {3}
    assert near_dedup.near_groups(nothing).count() == 0
    kept = near_dedup.drop_near(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text for r in kept.collect()]
    assert sum(t is not None and t.startswith("Same") for t in texts) == 1 and len(texts) == 6


def test_stage_takes_copies_and_leaves_others(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for key in range(120):
        words = list(rng.choice(vocabulary, 300))
        rows.append((key, " ".join(words)))
        near = list(words)
        for at in rng.choice(300, 4, replace=False):  # similarity of about 0.87
            near[at] = "changed"
        rows.append((1000 + key, " ".join(near)))
        far = list(words)
        for at in rng.choice(300, 60, replace=False):  # about 0.2
            far[at] = "other"
        rows.append((2000 + key, " ".join(far)))
    kept = {r.doc_id for r in near_dedup.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in kept if k < 1000} == set(range(120)) and len({k for k in kept if k >= 2000}) == 120
    assert len({k for k in kept if 1000 <= k < 2000}) <= 4


def test_stage_equals_all_pairs_on_sets(spark):
    """Similarities from 0.7 to 0.9, one group of many variations, equal fingerprints of unlike sets: links at 0.8 and no others."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for key in range(150):
        words = list(rng.choice(vocabulary, int(rng.integers(6, 120))))
        texts[2 * key] = " ".join(words)
        cut = int(round(len(words) * rng.uniform(0.02, 0.3)))
        texts[2 * key + 1] = " ".join(words[cut:] if key % 2 else words[: len(words) - cut] + list(rng.choice(vocabulary, cut // 3)))
    base = list(rng.choice(vocabulary, 150))
    for key in range(300, 420):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
            words[at] = str(rng.choice(vocabulary))
        texts[key] = " ".join(words)
    for key in range(420, 426):  # one shingle rules the fingerprint, the sets have little in common
        texts[key] = "same " * 400 + " ".join(rng.choice(vocabulary, 60))
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.split()) for k, t in texts.items())}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in texts:
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {find(k) for k in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert 150 < len(want) < 400
    assert {r.doc_id for r in near_dedup.drop_near(docs).collect()} == want


def test_keys_that_meet_across_batches():
    import pyarrow as pa

    keys = [1, 2, 2, 2, 2, 3, 4, 4, 5]
    for cut in (1, 2, 3, 9):
        batches = [pa.RecordBatch.from_pydict({"key": keys[i : i + cut], "row": list(range(i, min(9, i + cut)))}) for i in range(0, 9, cut)]
        assert [r for b in near_dedup._met(iter(batches)) for r in b.column(1).to_pylist()] == [1, 2, 3, 4, 6, 7]


def test_near_copies_unlike_the_first_leaders_are_not_squared(spark, monkeypatch):
    """Long tails are unlike each other and like the few short ones; new leaders find those before any pairs are made."""
    bodies = [" ".join(f"g{g}w{i}" for i in range(60)) for g in range(2)]
    tails = [(g, i, 5 if i % 8 == 3 else 9) for g in range(2) for i in range(600)]
    texts = [f"{bodies[g]} " + " ".join(f"g{g}t{i}x{k}" for k in range(n)) for g, i, n in tails]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, real = [], near_dedup.written

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == [0, 600]
    assert max(made) < 20 * len(texts), made


def test_similar_texts_of_a_tree_are_linked_where_its_forest_is_not(spark, monkeypatch):
    """Equal and near fingerprints, the forest's root unlike the rest: the trees find the similar ones without shared keys."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    unlike = [list(rng.choice(vocabulary, 60)) for _ in range(30)]
    texts = ["same " * 400 + " ".join(words) for words in unlike]  # one shingle rules the fingerprint
    texts += ["same " * 400 + " ".join([*words[:-1], "z"]) for words in unlike[10:25]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == list(range(30))
    monkeypatch.setattr(near_dedup, "_met", lambda batches: iter(()))
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == list(range(30))

"""BPE by segment trees: against the tokenizers library, and as an exact round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalweir.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def ids_of(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


TEXTS = [
    "", " ", "a", "ab", "  two  spaces \n\n and\tlines ", "it's we'll don't I'VE", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x",
    "x<|endoftext", "ümläut é 日本語 🙂 text", "՘ a֋b ꟎1 \U0003fc3b", "\x00\x01\x85 ", "1234567 12,345.67", "aaaaaaaaaaaaaaaaaaaaaaaaa",
    "é́ ‍️", "!?!?!?...", "word " * 3000, "ab" * 5000, "-" * 4097, " " * 1000 + "x",
]


def test_equals_the_library(encoder, library):
    assert ids_of(encoder, TEXTS) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | st.text("ab '\n\tsté") | st.text(st.characters(min_codepoint=0x500, max_codepoint=0x20000, exclude_categories=["Cs"])), max_size=4))
def test_any_text(encoder, library, texts):
    assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode_as_the_library_does(library, ids):
    got = bpe.decoder(PATH)(np.array(ids, np.int64)).decode("utf-8", "replace") if ids else ""
    assert got == library.decode(ids, skip_special_tokens=False)


def test_leftmost_lowest_pair_by_hand(encoder):
    """The tree against merging by a plain scan of all pairs."""
    v = encoder.v
    rank = {tuple(divmod(k, 1 << 32)): int(r) for k, r in zip(v._keys.tolist(), v._ranks.tolist())}
    rng = np.random.default_rng(3)
    for _ in range(200):
        chunk = bytes(rng.choice(list(b"theinrsa "), rng.integers(1, 70)).tolist())
        ids = [int(v.byte_ids[b]) for b in chunk]
        while pairs := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
            r, i = min(pairs)
            ids[i : i + 2] = [int(v.merged[r])]
        assert np.frombuffer(bpe.merged_ids(v, [chunk])[0], "<u4").tolist() == ids


def test_memory_starts_anew(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    texts = [f"some {i} words {i * i} here" for i in range(50)]
    assert [ids_of(encoder, [t])[0] for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_equals_the_library(spark, library, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_bpe"](spark, SF).collect()}
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        )


def test_awkward_rows(spark, awkward, nothing, library):
    got = bpe.decode(bpe.encode(awkward, PATH), PATH).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in awkward.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0
    broken = spark.createDataFrame([([164, 50256, 999999, None],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(broken, PATH).select("decoded").collect()] == ["�<|endoftext|>", "", ""]


def test_other_columns_clash(spark, awkward):
    clashing = awkward.withColumnsRenamed({"text": "ids", "doc_id": "id"}).withColumn("decoded", F.lit(1))
    assert bpe.encode(clashing, PATH, "id", "ids").columns == ["id", "ids"]

"""Byte-level BPE over a segment tree of adjacent pair ranks.

A chunk of text is a row of byte symbols. Over its adjacent pairs lies a segment tree whose
leaves are the pairs' merge ranks and whose nodes hold the least (rank, position) below, so
the root names the leftmost pair of lowest rank. Merging it changes three leaves: the pair
itself, the pair that is gone and the pair before; their paths to the root are worked out
anew, a logarithm of the chunk's length, until no pair can merge.

Chunks repeat, so a worker remembers the ids of those it has met and lays only new ones
into trees: all new chunks of a batch at once, those of like length side by side, each tree
a row of one array, every step one numpy operation over all rows that still merge. Chunks
that are longer than a row's share of memory have a tree of their own.

Texts are cut at the vocabulary's added tokens first, then by the split pattern, as the
tokenizers library does. Its tables know fewer letters than the regex module's; texts with
code points that only one of the two may know as a letter are cut by that library's own
pre-tokenizer.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

#: Distinct chunks whose ids a worker remembers; beyond it starts anew.
MEMORY = 300_000
#: Pairs that the trees of one step hold at most; a longer chunk is a step of its own.
CELLS = 1 << 20
NONE = np.iinfo(np.int64).max


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a file of the tokenizers library, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


class Vocabulary:
    """Merge ranks, token bytes and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        names, model = byte_names(), held["model"]
        ids = model["vocab"]
        self.added = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(names[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c, _ in sorted(names.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        by_key = np.argsort(key)
        self._keys, self._ranks = key[by_key], by_key

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, -1 where there is none."""
        if not len(self._keys):
            return np.full(left.shape, -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)


class Trees:
    """Segment trees over the adjacent pairs of several byte strings, one row each.

    Node 1 is a row's root, nodes `width` and up its leaves; a leaf is rank * width + place,
    so the least of two leaves is the lower rank and, at equal rank, the one further left.
    """

    def __init__(self, vocabulary: Vocabulary, chunks: list[bytes]):
        self.v = vocabulary
        n, longest = len(chunks), max(map(len, chunks))
        self.width = 1 << max(0, (longest - 2).bit_length())
        self.size = np.array([len(c) for c in chunks])
        raw = np.frombuffer(b"".join(c.ljust(self.width + 1, b"\0") for c in chunks), np.uint8).reshape(n, -1)
        place = np.arange(self.width + 1)
        self.live = place < self.size[:, None]
        self.symbol = self.v.byte_ids[raw]
        self.after = np.tile(place + 1, (n, 1))
        self.before = np.tile(place - 1, (n, 1))
        self.tree = np.full((n, 2 * self.width), NONE)
        ranks = self.v.ranks(self.symbol[:, :-1], self.symbol[:, 1:])
        self.tree[:, self.width :] = np.where((ranks >= 0) & self.live[:, 1:], ranks * self.width + place[:-1], NONE)
        level = self.width
        while level > 1:
            self.tree[:, level // 2 : level] = np.minimum(self.tree[:, level : 2 * level : 2], self.tree[:, level + 1 : 2 * level : 2])
            level //= 2

    def merge(self) -> None:
        """Merge until no root names a pair."""
        rows = np.flatnonzero(self.tree[:, 1] != NONE)
        while len(rows):
            rank, left = np.divmod(self.tree[rows, 1], self.width)
            right = self.after[rows, left]
            beyond = self.after[rows, right]
            self.symbol[rows, left] = self.v.merged[rank]
            self.live[rows, right] = False
            self.after[rows, left] = beyond
            inside = beyond < self.size[rows]
            self.before[rows[inside], beyond[inside]] = left[inside]
            ahead = self.before[rows, left]
            self._set(rows, right, None)
            self._set(rows, left, np.where(inside, beyond, -1))
            some = ahead >= 0
            self._set(rows[some], ahead[some], left[some])
            rows = rows[self.tree[rows, 1] != NONE]

    def _set(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> None:
        """The leaf of the pair (left, right) anew, none where right is -1, and its path to the root."""
        leaf = np.full(len(rows), NONE)
        if right is not None:
            ranks = self.v.ranks(self.symbol[rows, left], self.symbol[rows, np.maximum(right, 0)])
            leaf = np.where((right >= 0) & (ranks >= 0), ranks * self.width + left, NONE)
        # the last symbol has no pair to its right; its leaf may lie outside the tree
        held = left < self.width
        rows, at, leaf = rows[held], left[held] + self.width, leaf[held]
        self.tree[rows, at] = leaf
        while (at := at >> 1).any():
            self.tree[rows, at] = np.minimum(self.tree[rows, 2 * at], self.tree[rows, 2 * at + 1])

    def ids(self) -> list[bytes]:
        """The symbols left in each row, as little-endian unsigned 32-bit integers."""
        flat = self.symbol[self.live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(self.live.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merged_ids(vocabulary: Vocabulary, chunks: list[bytes]) -> list[bytes]:
    """The ids of each chunk by BPE; chunks of like length share an array of trees."""
    out: list[bytes] = [b""] * len(chunks)
    order = sorted((i for i in range(len(chunks)) if chunks[i]), key=lambda i: len(chunks[i]))
    at = 0
    while at < len(order):
        width = 1 << max(0, (len(chunks[order[at]]) - 2).bit_length())
        end = at + 1
        while end < len(order) and len(chunks[order[end]]) <= width + 1 and (end - at + 1) * width <= CELLS:
            end += 1
        trees = Trees(vocabulary, [chunks[i] for i in order[at:end]])
        trees.merge()
        for i, ids in zip(order[at:end], trees.ids()):
            out[i] = ids
        at = end
    return out


class Splitter:
    """Cuts a text into chunks as the tokenizers library does: at added tokens, then by the split pattern."""

    def __init__(self, path: str, added: dict[str, int]):
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._exact = Tokenizer.from_file(path).pre_tokenizer
        #: Code points that Python's tables do not know: the only ones on which the two may differ.
        self._newer = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def parts(self, text: str) -> list[str]:
        """Plain text at even places, added tokens between."""
        return self._added.split(text) if self._added else [text]

    def chunks(self, text: str) -> list[str]:
        if not text.isascii() and self._newer[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
            return [text[a:b] for _, (a, b) in self._exact.pre_tokenize_str(text)]
        return self.pattern.findall(text)


class Encoder:
    """Texts to ids, batch by batch, with a memory of chunks."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.splitter = Splitter(path, self.v.added)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = []
        new: set[str] = set()
        for text in texts:
            parts = self.splitter.parts(text)
            plain = [self.splitter.chunks(p) for p in parts[::2]]
            for chunks in plain:
                new.update(chunks)
            cut.append((plain, parts[1::2]))
        if len(self.known) + len(new) > MEMORY:
            self.known = {c: self.known[c] for c in new if c in self.known}
        fresh = [c for c in new if c not in self.known]
        self.known.update(zip(fresh, merged_ids(self.v, [c.encode() for c in fresh])))
        ids = self.known.__getitem__
        out = []
        for plain, added in cut:
            got = [b"".join(map(ids, plain[0]))]
            for token, chunks in zip(added, plain[1:]):
                got.append(self.v.added[token].to_bytes(4, "little"))
                got.extend(map(ids, chunks))
            out.append(b"".join(got))
        return out


def _lists(blobs: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def encoded(text: Column, vocabulary: str) -> Column:
    """array<int> of the ids of a text column, null as empty, by the tokenizers file at `vocabulary`.

    Added tokens in the text are found as that library finds them; none are added.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            yield _lists(encoder.encode([t or "" for t in texts.to_pylist()]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<int>").asNondeterministic()(text)


def decoder(vocabulary: str) -> Callable[[np.ndarray], bytes]:
    """Ids to the bytes that their tokens stand for; an id outside the vocabulary stands for none."""
    tokens = Vocabulary(vocabulary).tokens
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    size = np.array([len(t) for t in tokens] + [0])
    start = np.concatenate([[0], np.cumsum(size[:-1])])

    def run(ids: np.ndarray) -> bytes:
        ids = np.where((ids >= 0) & (ids < len(tokens)), ids, len(tokens))
        n = size[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return flat[np.arange(ends[-1]) + np.repeat(start[ids] - ends + n, n)].tobytes()

    return run


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text of an array<int> column of ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = decoder(vocabulary)
        for rows in batches:
            out = []
            for i in range(len(rows)):
                held = rows[i].values
                out.append(decode(held.drop_null().to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if held is not None else "")
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "string").asNondeterministic()(ids)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array<int>).

    Null texts are empty and have no ids; repeated rows each count; an empty table gives
    none. Other columns are not read.
    """
    return docs.select(F.col(id_col).alias("id"), encoded(F.col(text_col), vocabulary).alias("ids"))


def decode(encoded_docs: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded_docs` with the text of its ids as column `out`, which must be a new name."""
    return encoded_docs.withColumn(out, decoded(F.col(ids_col), vocabulary))

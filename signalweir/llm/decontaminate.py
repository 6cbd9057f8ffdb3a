"""Benchmark decontamination by a broadcast hash set of test n-grams.

Windows of `window` consecutive words of the benchmark's items (the whole item where it is
shorter) go out as a table of rolling hashes over word numbers. Each task slides the same
hash over the words of its texts; a hash that is in the table is verified word by word, and
verified places come back as spans with their items.

The table is broadcast in parts of at most `part_windows` windows, each scanned by a step
of its own, so neither the driver nor a worker holds more than its size at once and a larger
benchmark takes more steps over each text, not more memory. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalweir.llm.common import WORD_TABLE, as_bytes, free_name, words_of, written

SPAN = "array<struct<first:int,last:int,items:array<string>>>"
SCAN = f"struct<n_words:long,spans:{SPAN}>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Windows of a part of the benchmark, by length: sorted hashes, and word numbers to items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                found.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.found = {k: sorted(v) for k, v in found.items()}
        self.hashes = {
            n: np.unique(np.concatenate([rolling(np.array(k, np.uint64), n) for k in self.found if len(k) == n]))
            for n in sorted({len(k) for k in self.found})
        }

    def spans(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, last word, items) of each place of `words` where a window stands."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        out = []
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            # places whose n words all occur in the benchmark
            whole = np.flatnonzero(np.convolve(ids == 0, np.ones(n, np.int64), "valid") == 0)
            if not len(whole):
                continue
            keys = rolling(ids.astype(np.uint64), n)[whole]
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for i in whole[hashes[at] == keys].tolist():
                if items := self.found.get(tuple(ids[i : i + n].tolist())):
                    out.append((i, i + n - 1, items))
        return out


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash, modulo 2 to the 64, of each run of n word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * _FACTOR + ids[i : len(ids) - n + 1 + i]
    return out


def _scan(windows) -> object:
    """Column function: text to its number of words and the spans of this part's windows."""

    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.string()))])
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span))])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part = windows.value
        for batch in texts:
            rows = []
            for data in as_bytes(batch):
                words = words_of(data)
                rows.append({"n_words": len(words), "spans": [{"first": f, "last": e, "items": k} for f, e, k in part.spans(words)]})
            yield pa.array(rows, kind)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, SCAN).asNondeterministic()


def with_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 10, part_windows: int = 1 << 20, out: str = "contamination",
) -> DataFrame:
    """`docs` with a column `out`: struct of n_words and spans (first, last, items) of benchmark windows.

    Null and empty texts and items have no words and no spans; items without an id are left
    out; repeated rows are each scanned; an empty benchmark leaves every text clean.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("data")
    )
    # an item has at most a window for each two bytes
    size = items.agg(F.sum(F.floor(F.octet_length("data") / 2) + 1)).first()[0] or 0
    parts = max(1, -(-int(size) // part_windows))
    found = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()  # about part_windows windows
        sent = spark.sparkContext.broadcast(Windows([(r.item, bytes(r.data)) for r in rows], window))
        scan = _scan(sent)(F.col(text_col))
        if found is None:
            docs, found = docs.withColumn(out, scan), F.col(out)
        else:
            # a pass of its own a part: what it found is written, its set is dropped before the next is sent
            more = free_name(docs, "_more_spans")
            merged = F.struct(found["n_words"].alias("n_words"), F.concat(found["spans"], F.col(more)["spans"]).alias("spans"))
            docs = docs.withColumn(more, scan).withColumn(out, merged).drop(more)
        if parts > 1:
            docs = written(docs)
            sent.destroy()
    return docs


def hit_words(spans: Column) -> Column:
    """How many word places the spans cover; overlapping spans count once."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))

    def step(at, s):
        new = F.greatest(s["last"] - F.greatest(at["last"], s["first"] - 1), F.lit(0))
        return F.struct(F.greatest(at["last"], s["last"]).alias("last"), (at["n"] + new).alias("n"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    return F.aggregate(ordered, zero, step)["n"]


def hit_items(spans: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: s["items"])))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark window, columns as they were."""
    name = free_name(docs, "_contamination")
    return with_spans(docs, benchmark, text_col, window=window, out=name).where(F.size(F.col(name)["spans"]) == 0).drop(name)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """`docs` with the hit words taken out of the text, the text between the others as it was."""
    name = free_name(docs, "_contamination")
    found = with_spans(docs, benchmark, text_col, window=window, out=name)

    def run(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, spans in texts:
            yield pa.array([None if t is None else _without(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.string())

    run.__annotations__ = {"texts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    cut = arrow_udf(run, "string")(F.col(text_col), F.col(name)["spans"])
    return found.withColumn(text_col, cut).drop(name)


def _without(text: str, spans: list[dict]) -> str:
    if not spans:
        return text
    data = text.encode()
    plain = np.frombuffer(data.translate(WORD_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = np.ones(len(data), bool)
    for s in spans:
        keep[starts[s["first"]] : ends[s["last"]]] = False
    return np.frombuffer(data, np.uint8)[keep].tobytes().decode()

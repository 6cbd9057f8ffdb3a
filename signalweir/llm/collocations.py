"""Phrase collocations by Rabin-Karp fingerprints.

Texts are bytes in numpy. A prefix polynomial over the bytes gives every word's hash, a
prefix polynomial over the word hashes every n-gram's fingerprint, both modulo 2^64, where
odd bases have inverses: (P[j] - P[i]) * base^-i is the same wherever the words stand.

Phrases are counted by length, shortest first. A task cuts its words into blocks, sorts a
block's fingerprints and sends each distinct one with its count to the bucket of its first
bits. A bucket adds the counts up and answers with bits: its share of a sieve that says
which fingerprints are frequent. A phrase can only be frequent if its first and its last
words but one are, so the next length counts no n-gram that the sieve below rules out.
The sieve has a fixed number of bits: false positives cost shuffle, never results.

Last, what passes the sieves of every length is counted exactly. In a block an occurrence
is a pointer to its first word; words of one hash are compared byte by byte and the
occurrences of one fingerprint word by word, each to one of them, and only the text
at that pointer leaves the task, with its count. Where the comparison finds a collision,
the block is grouped by its words instead. Phrases of different tasks meet by their text,
so no collision can add up two of them, and text moves for frequent phrases only.

A block's last words open the next one, so neither blocks nor pieces of long texts lose an
n-gram at their borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.llm.common import LOWER_TABLE, as_bytes, partitions, written
from signalweir.scale import top_per_key

#: Words and bytes of a block, and the bytes that are hashed at once.
BLOCK_WORDS, SLICE_BYTES = 3 << 18, 1 << 19
#: Bits of a sieve, which is broadcast: 8 MB.
SIEVE_BITS = 26
#: Bytes of text for each bucket of fingerprints, and the most buckets.
BUCKET_BYTES, MAX_BUCKET_BITS = 1 << 22, 20
#: Bits of a print behind its bucket's: a bucket has fewer distinct prints than 2^20.
PRINT_BITS = 24
#: Odd bases of the two polynomials.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Kinds of bytes: part of a word, blank between words, end of a piece.
KIND = bytes(2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256))
U64 = np.uint64


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all, one to one."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Grams:
    """Words and n-gram fingerprints of a block of texts.

    `weak` keeps so many bits of every hash only: tests make collisions with it.
    """

    def __init__(self, weak: int = 64):
        self.mask = U64((1 << weak) - 1)
        n = SLICE_BYTES + 1
        self._up, self._down = powers(BYTE_BASE, n), powers(inverse(BYTE_BASE), n)
        self.langs: list[str] = []
        self._lang_at: dict[str, int] = {}
        self._salts = np.zeros(0, U64)
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.starts, self.sizes, self.pieces, self.lang = [], [], [], [], []
        self.data: list[bytes] = []
        self.words = self.bytes = self.piece = 0

    def add(self, lang: str, data: bytes) -> Iterator[None]:
        """Adds a text; yields whenever the block is full, before more is added."""
        code = self._lang_at.get(lang)
        if code is None:
            code = self._lang_at[lang] = len(self.langs)
            self.langs.append(lang)
            self._salts = np.append(self._salts, U64(xxhash.xxh64_intdigest(lang.encode())))
        data = data.translate(LOWER_TABLE) + b"\n"
        kinds = data.translate(KIND)
        at = 0
        while at < len(data):
            end = min(len(data), at + SLICE_BYTES)
            if end < len(data):  # a slice ends behind a byte of no word
                cut = max(kinds.rfind(b"\1", at, end), kinds.rfind(b"\2", at, end)) + 1
                nexts = [x + 1 for x in (kinds.find(b"\1", end), kinds.find(b"\2", end)) if x >= 0]
                end = cut if cut > at else min(nexts)
            self._slice(code, data[at:end], np.frombuffer(kinds, np.uint8)[at:end])
            at = end
            if self.words >= BLOCK_WORDS:
                yield None

    def _slice(self, code: int, data: bytes, kinds: np.ndarray) -> None:
        inside = np.concatenate([[0], (kinds == 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        if len(data) >= len(self._up):
            up, down = powers(BYTE_BASE, len(data) + 1), powers(inverse(BYTE_BASE), len(data) + 1)
        else:
            up, down = self._up, self._down
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
        words = mixed((prefix[ends] - prefix[starts]) * down[starts])
        self.hashes.append(words & self.mask)
        self.starts.append(starts + self.bytes)
        self.sizes.append(ends - starts)
        closed = np.cumsum(kinds == 2)
        self.pieces.append(self.piece + closed[starts])
        self.lang.append(np.full(len(starts), code, np.int32))
        self.piece += int(closed[-1])
        self.data.append(data)
        self.words += len(starts)
        self.bytes += len(data)

    def close(self) -> None:
        """Makes one array of each list; n-grams can be asked for from here on."""
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.h, self.at, self.size = join(self.hashes, U64), join(self.starts, np.int64), join(self.sizes, np.int64)
        self.in_piece, self.code = join(self.pieces, np.int64), join(self.lang, np.int32)
        up = powers(WORD_BASE, len(self.h))
        self._grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._prefix = np.concatenate([np.zeros(1, U64), np.cumsum(self.h * up, dtype=U64)])
        self._back = powers(inverse(WORD_BASE), len(self.h))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams start, and their fingerprints; the language is part of a fingerprint."""
        if n in self._grams:
            return self._grams[n]
        count = max(0, len(self.h) - n + 1)
        places = np.flatnonzero(self.in_piece[:count] == self.in_piece[n - 1 : n - 1 + count])
        poly = (self._prefix[places + n] - self._prefix[places]) * self._back[places]
        prints = mixed(poly ^ self._salts[self.code[places]] ^ U64(n)) & self.mask
        # a weak print keeps its high end, where buckets and sieves look
        self._grams[n] = places, prints << U64(64 - int(self.mask).bit_length())
        return self._grams[n]

    def sieved(self, n: int, sieves: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the n-grams whose first and last n-1 words pass their sieve."""
        places, prints = self.grams(n)
        if n > 1 and len(places):
            shorter, below = self.grams(n - 1)
            ok = np.zeros(len(self.h) + 1, bool)
            ok[shorter[passes(sieves[n - 2], below)]] = True
            keep = ok[places] & ok[places + 1]
            places, prints = places[keep], prints[keep]
        if least:
            keep = passes(sieves[n - 1], prints)
            places, prints = places[keep], prints[keep]
        return places, prints

    def carry(self, n: int) -> None:
        """Starts the next block with this one's last n words, which stand in for what follows them there."""
        keep = min(n, len(self.h))
        tail = slice(len(self.h) - keep, len(self.h))
        data = b"".join(self.data)
        first = int(self.at[tail][0]) if keep else len(data)
        held = [x[tail] for x in (self.h, self.at - first, self.size, self.in_piece, self.code)]
        piece = self.piece
        self._empty()
        self.piece, self.words = piece, keep
        self.hashes, self.starts, self.sizes, self.pieces, self.lang = ([x] for x in held)
        self.data, self.bytes = [data[first:]], len(data) - first

    def exact(self, places: np.ndarray, prints: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(place of one occurrence, count) of each distinct n-gram, told apart by words and language."""
        order = np.argsort(prints)
        places, prints = places[order], prints[order]
        new = np.concatenate([[True], prints[1:] != prints[:-1]])
        heads = np.flatnonzero(new)
        first = places[heads[np.cumsum(new) - 1]]
        same = self.code[first] == self.code[places]
        for k in range(n):
            same &= self.word[first + k] == self.word[places + k]
        if same.all():
            counts = np.diff(np.append(heads, len(places)))
            yield from zip(places[heads].tolist(), counts.tolist())
            return
        key = np.stack([self.code[places], *(self.word[places + k] for k in range(n))], axis=1)
        _, at, counts = np.unique(key, axis=0, return_index=True, return_counts=True)
        yield from zip(places[at].tolist(), counts.tolist())

    def name_words(self) -> None:
        """`word`: equal for equal words only. The hash, unless two words of the block share one."""
        self.text = b"".join(self.data)
        # the eight bytes from each place on, as one number
        padded = np.frombuffer(self.text + bytes(8), np.uint8)
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(self.text) + 1,), (1,), writeable=False)
        order = np.argsort(self.h)
        new = np.concatenate([[True], self.h[order][1:] != self.h[order][:-1]]) if len(order) else np.zeros(0, bool)
        head = np.empty(len(order), np.int64)
        head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
        clean = bool((self.size == self.size[head]).all())
        one, two, left = self.at, self.at[head], self.size
        while clean and len(left):
            over = (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64)))
            clean = bool((((eight[one] ^ eight[two]) << over) == 0).all())
            more = left > 8
            one, two, left = one[more] + 8, two[more] + 8, left[more] - 8
        if clean:
            self.word = self.h
        else:
            known: dict[bytes, int] = {}
            spans = zip(self.at.tolist(), (self.at + self.size).tolist())
            self.word = np.array([known.setdefault(self.text[a:b], len(known)) for a, b in spans], U64)

    def phrase(self, place: int, n: int) -> str:
        a, z = self.at[place : place + n].tolist(), self.size[place : place + n].tolist()
        return b" ".join(self.text[x : x + y] for x, y in zip(a, z)).decode("utf-8", "replace")


def passes(sieve: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bit = prints >> U64(64 - SIEVE_BITS)
    return (sieve[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, weak: int) -> Iterator[tuple[Grams, int]]:
    """Blocks of (lang, text) batches, closed, and how many of their words are new: the last ones come again."""
    grams = Grams(weak)

    def closed(last: bool):
        grams.close()
        return grams, len(grams.h) if last else len(grams.h) - longest + 1

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            for _ in grams.add(lang, text):
                yield closed(False)
                grams.carry(longest - 1)
    yield closed(True)


def _sieve(texts: DataFrame, n: int, sieves: list, min_count: int, buckets: int, longest: int, weak: int) -> np.ndarray:
    """The bits of the n-grams that occur at least min_count times, as a bitmap by their first bits."""
    sent = texts.sparkSession.sparkContext.broadcast(sieves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, own in _blocks(batches, longest, weak):
            places, prints = grams.sieved(n, sent.value, 0)
            prints = np.sort(prints[places < own])
            if not len(prints):
                continue
            heads = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            counts = np.diff(np.append(heads, len(prints))).astype(np.uint32)
            prints = prints[heads]
            bucket = (prints >> U64(64 - buckets)).astype(np.int64) if buckets else np.zeros(len(prints), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(prints)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges[:-1]], pa.int64()), pa.array([_short(prints[a:b], buckets) for a, b in zip(edges, edges[1:])], pa.binary()),
                 pa.array([_packed(counts[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())],
                names=["bucket", "prints", "counts"],
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prints, counts, loose = None, [], [], 0

        def compact() -> None:
            p, c = np.concatenate(prints), np.concatenate(counts)
            order = np.argsort(p)
            p, c = p[order], c[order]
            heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            prints[:], counts[:] = [p[heads]], [np.add.reduceat(c, heads)]

        def bits() -> pa.RecordBatch:
            compact()
            often = prints[0][counts[0] >= min_count] >> U64(64 - SIEVE_BITS)
            often, shift = np.unique(often).astype(np.int64), SIEVE_BITS - buckets
            lo = held << shift
            size = max(8, 1 << shift)
            lo -= lo % 8
            part = np.zeros(size, np.uint8)
            part[often - lo] = 1
            return pa.RecordBatch.from_arrays([pa.array([lo // 8], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], names=["at", "bits"])

        for batch in batches:
            for bucket, p, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if held is not None and bucket != held:
                    yield bits()
                    prints, counts, loose = [], [], 0
                held = bucket
                one = _long(p.as_py(), bucket, buckets)
                prints.append(one)
                counts.append(_unpacked(c.as_py(), len(one)))
                loose += len(one)
                if loose > 1 << 22:
                    compact()
                    loose = 0
        if held is not None:
            yield bits()

    partial = texts.mapInArrow(count, "bucket long, prints binary, counts binary")
    dealt = partial.repartition(partitions(texts.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for part in dealt.mapInArrow(add_up, "at long, bits binary").toArrow().to_batches():
        for at, bits in zip(part.column(0).to_pylist(), part.column(1)):
            one = np.frombuffer(bits.as_py(), np.uint8)
            found[at : at + len(one)] |= one
    return found


def _kept(buckets: int) -> int:
    """The bits of a print that are sent, behind its bucket's: with those, enough for the sieve and to tell a bucket's prints apart."""
    return max(PRINT_BITS, SIEVE_BITS - buckets)


def _short(prints: np.ndarray, buckets: int) -> bytes:
    """Sorted prints of a bucket as steps from one to the next, their low bytes first: most high bytes are zero and compress.

    Prints that agree in the kept bits are counted as one, which only lets more pass.
    """
    steps = np.diff((prints << U64(buckets)) >> U64(64 - _kept(buckets)), prepend=U64(0))
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _long(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    prints = np.cumsum(steps, dtype=U64) << U64(64 - _kept(buckets) - buckets)
    return prints | U64(bucket << (64 - buckets) if buckets else 0)


def _packed(counts: np.ndarray) -> bytes:
    """Mostly ones: a byte each, and the few large ones behind."""
    large = np.flatnonzero(counts > 254)
    small = counts.astype(np.uint8)
    small[large] = 255
    return small.tobytes() + counts[large].astype("<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=n)
    return out


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10, weak: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of every phrase of up to `longest` words that occurs at least min_count times
    in its language, and (lang, n) of all words.

    A-Z is lower-cased; pieces end at `[.,;:!?]` and line ends, words at spaces and tabs.
    Null languages are `und`, null texts empty; repeated rows each count. An empty table
    gives none. Other columns are not read.
    """
    if longest < 1 or min_count < 1:
        raise ValueError("longest and min_count must be positive")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MAX_BUCKET_BITS, (total // BUCKET_BYTES).bit_length())
    sieves: list[np.ndarray] = []
    for n in range(1, longest + 1):
        sieves.append(_sieve(texts, n, sieves, min_count, buckets, longest, weak))
    sent = texts.sparkSession.sparkContext.broadcast(sieves)

    # a row is one key and its count: no phrase has a line end, whatever is in a language's name
    def phrases(grams: Grams, own: int, n: int) -> Iterator[tuple[str, int]]:
        places, prints = grams.sieved(n, sent.value, min_count)
        keep = places < own
        if keep.any():
            for at, m in grams.exact(places[keep], prints[keep], n):
                yield f"{grams.langs[grams.code[at]]}\n{grams.phrase(at, n)}", m

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64())
        for grams, own in _blocks(batches, longest, weak):
            grams.name_words()
            words = np.bincount(grams.code[:own], minlength=len(grams.langs))
            totals = [(f"{lang}\n", n) for lang, n in zip(grams.langs, words.tolist()) if n]
            for rows in batched(chain(totals, *(phrases(grams, own, n) for n in range(1, longest + 1))), 1 << 13):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "f"])

    found = texts.mapInArrow(count, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    named = found.where((F.col("f") >= min_count) | (phrase == "")).select(
        F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang"),
        F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "f",
    )
    summed = written(named)
    return summed.where("words > 0"), summed.where("words = 0").select("lang", F.col("f").alias("n"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10, share: int = 50,
    k: int = 2000, weak: int = 64,
) -> DataFrame:
    """The first k collocations of each language: lang, rank, phrase, a, l, r, n, score, words.

    A candidate has 2 to `longest` words and occurs a >= min_count times. Cut in two, its
    parts occur l and r times; its score is floor(1000000 a a / (l r)) at the cut where
    that is least (then the earliest). A candidate inside a longer one that has `share`
    percent of its occurrences or more is left out. Exact: decimals hold the products.
    """
    if longest < 2:
        raise ValueError("longest must be two or more")
    phrases, totals = frequent_phrases(docs, text_col, lang_col, longest, min_count, weak)
    parts = F.split("phrase", " ")
    many = phrases.where("words > 1").withColumn("w", parts)
    cut = many.select(
        "lang", F.col("f").alias("a"), F.explode(F.expr("""transform(sequence(1, words - 1), k -> struct(
            k, array_join(slice(w, 1, k), ' ') AS first, array_join(slice(w, k + 1, words - k), ' ') AS rest))""")).alias("c"),
    ).select("lang", "a", "c.*")
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = {x: F.col(x).cast("decimal(19,0)") for x in "alr"}
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({f"d{x}": wide[x] for x in "alr"})
    score = F.expr("CAST(CAST(1000000 AS DECIMAL(38,0)) * (da * da) AS DECIMAL(38,0)) div (dl * dr)")
    whole = F.concat_ws(" ", "first", "rest").alias("phrase")
    best = scored.groupBy("lang", whole).agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b"))
    inner = many.where("words > 2").select(
        "lang", F.col("f").alias("longer"), F.explode(F.expr("""flatten(transform(sequence(2, words - 1), n ->
            transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))""")).alias("phrase"),
    )
    inside = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = best.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(share)} * b.a"))
    flat = held.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score", F.size(F.split("phrase", " ")).alias("words")).join(totals, "lang")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    return top_per_key(flat, ["lang"], order, k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words")

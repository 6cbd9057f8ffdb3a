"""SimHash near-dedup over vantage-point trees.

Fingerprints are collapsed to distinct values first (copies cost one row). The trees' top
levels measure Hamming distance under masks: the bits are cut into disjoint masks, and for
each mask a fingerprint goes to the shard of its masked distances. By the triangle bound,
two fingerprints whose masked distance is 0 have equal distance to every vantage point of
that mask, so they share its shard; with radius r and r + 1 masks, two linked fingerprints
agree under one mask at least. (Unmasked distances of 64 random bits all lie near 32, so a
vantage point's ring overlaps nearly every other at radius 4 and prunes nothing there.)

Inside a shard an ordinary tree of vantage points goes on under the whole distance: split
at the median, visit both sides only where |d - median| <= radius. Points within the radius
of a vantage point are linked to it and need not meet each other again, so thousands of
near copies cost a pass, not their square, and a shard returns a spanning forest, not its
pairs. Shards beyond `limit` points are cut into blocks that meet two by two, in tasks of
at most twice that size: exact, with bounded memory.

drop_near() takes the links of the same trees first, over the SimHash of five-word shingles,
and verifies them on the shingle sets: it goes by their similarity, which no fingerprint tells
exactly. A forest's pairs need not be the similar ones of those it connects, so all that the
trees connect meets under its group, as under a key. Most sets of similarity 0.8 differ in more
than 4 bits; those are found by what they share. Sets as similar as `similarity` share a shingle among the first few of each in any one
order of all shingles; those few are the keys that documents meet under. Shingles that a
sample finds often come last in that order, so the keys are rare ones. Every link is verified
on the whole sets. Under each key all meet two leaders first, then rounds of four new ones for as long as
these link what the others did not; only what is still apart then meets in pairs, so a group
of near copies is not squared, also where they are unlike the first leaders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalweir.llm.common import as_bytes, partitions, tokens_of, written
from signalweir.llm.components import components

_LANES = np.uint64(0x0101010101010101)
_LEAF = 48
#: Rounds of new leaders at most, and one in how many of the rows must find a link for another. What is left meets in pairs.
ROUNDS, WORTH = 8, 16


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, joined by one space; the whole sequence if it is shorter."""
    words = tokens_of(data)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((h(line[s:e], 42) for s, e in cuts), np.uint64, len(words) - size + 1)


def _widen(h: np.ndarray, word: int) -> np.ndarray:
    """The word-th 64 bits grown from a hash; the first is the hash itself."""
    if not word:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list[bytes], width: int, size: int) -> list[bytes]:
    """Per text the bits set in over half its shingle hashes, as big-endian bytes; no words: zero."""
    return majorities([shingle_hashes(t, size) for t in texts], width)


def majorities(each: list[np.ndarray], width: int) -> list[bytes]:
    """Per list of hashes the bits set in over half of them, as big-endian bytes; none: zero."""
    counts = np.array([len(x) for x in each], np.int64)
    out = np.zeros((len(each), width // 64), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return [r.tobytes() for r in out.astype(">u8")]
    hashes = np.concatenate([each[i] for i in some])
    ends = np.cumsum(counts[some])
    starts = ends - counts[some]
    # runs of at most 255 hashes, so a byte lane cannot overflow
    runs = np.concatenate([np.arange(s, e, 255) for s, e in zip(starts, ends)])
    first_run = np.searchsorted(runs, starts)
    for word in range(width // 64):
        wide = _widen(hashes, word)
        for bit in range(8):
            lanes = np.add.reduceat((wide >> np.uint64(bit)) & _LANES, runs)
            sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
            for byte in range(8):
                over = sums[:, byte] * 2 > counts[some]
                out[some, word] |= over.astype(np.uint64) << np.uint64(8 * byte + bit)
    return [r.tobytes() for r in out.astype(">u8")]


def simhash(width: int = 64, size: int = 4):
    """Column function: text to fingerprint (binary, width / 8 bytes)."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(fingerprints_of(list(as_bytes(batch)), width, size), pa.binary())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "binary").asNondeterministic()


def masks_of(width: int, masks: int, bits: int) -> list[np.ndarray]:
    """Disjoint sets of bit positions, seeded; every bit is used when masks x bits cover the width."""
    order = np.random.default_rng(5).permutation(width)
    return [np.sort(m) for m in np.array_split(order, masks)] if masks * bits >= width else [np.sort(order[i * bits : (i + 1) * bits]) for i in range(masks)]


def _distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ one).sum(axis=-1, dtype=np.int64)


def links_within(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (distance at most `radius`) among the rows of `points`: (member, root)."""
    label = np.arange(len(points))
    one, two = [], []
    # a node: rows that are stored below it, and rows that look for links there
    todo = [(label, label)]
    while todo:
        held, seek = todo.pop()
        if not len(held) or not len(seek):
            continue
        if len(held) <= _LEAF:
            for at in range(0, len(seek), 4096):
                part = seek[at : at + 4096]
                i, j = np.nonzero(_distance(points[part][:, None], points[held][None]) <= radius)
                one.append(part[i])
                two.append(held[j])
            continue
        v = held[0]
        near_held, near_seek = _distance(points[held], points[v]), _distance(points[seek], points[v])
        hit = near_seek <= radius
        one.append(seek[hit])
        two.append(np.full(hit.sum(), v))
        ball = near_held <= radius
        # both in the ball: linked through v already
        one.append(held[ball])
        two.append(np.full(ball.sum(), v))
        todo.append((held[ball & (held != v)], seek[~hit & (near_seek <= 2 * radius)]))
        held, near_held = held[~ball], near_held[~ball]
        if not len(held):
            continue
        middle = int(np.median(near_held))
        if middle >= near_held.max():
            middle = int(near_held.max()) - 1
        inside = near_held <= middle
        if not inside.any():  # all at one distance: no split here, but the vantage point is gone
            todo.append((held, seek[(near_seek >= near_held.min() - radius) & (near_seek <= near_held.max() + radius)]))
            continue
        low = (near_seek <= middle + radius) & (near_seek >= near_held.min() - radius)
        high = (near_seek > middle - radius) & (near_seek <= near_held.max() + radius)
        todo.append((held[inside], seek[low]))
        todo.append((held[~inside], seek[high]))
    if not one:
        return label[:0], label[:0]
    a, b = np.concatenate(one), np.concatenate(two)
    keep = a != b
    a, b = a[keep], b[keep]
    if len(a):
        while True:
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _sharded(distinct: DataFrame, width: int, masks: int, bits: int) -> DataFrame:
    places = masks_of(width, masks, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0)
            flat = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, width // 8), axis=1)
            for number, mask in enumerate(places):
                key = flat[:, mask].astype(np.int64) @ (1 << np.arange(len(mask), dtype=np.int64)) + (number << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), fps], names=["shard", "fp"])

    return distinct.select("fp").mapInArrow(run, "shard long, fp binary")


def near_links(distinct: DataFrame, width: int, radius: int, masks: int, bits: int, limit: int = 1 << 16) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) that connect all that masks can reach within `radius`."""
    sharded = _sharded(distinct, width, masks, bits)
    sizes = sharded.groupBy("shard").count()
    cells = sharded.select("shard", F.lit(0).alias("cell"), "fp")
    if (sizes.agg(F.max("count")).first()[0] or 0) > limit:
        sizes = sizes.where(F.col("count") > limit).select(F.col("shard").alias("_s"), F.ceil(F.col("count") / limit).alias("_k"))
        # block i of k goes to the cells of its pairs (i, j), numbered i * k + j with i < j
        block = F.pmod(F.xxhash64("fp"), F.col("_k"))
        other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda j: j != F.col("_b"))
        cell = F.transform(other, lambda j: F.least("_b", j) * F.col("_k") + F.greatest("_b", j))
        cells = (
            sharded.join(sizes, F.col("shard") == F.col("_s"), "left").withColumn("_b", block)
            .select("shard", F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cell)).alias("cell"), "fp")
        )
    words = width // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fps: list[bytes]) -> Iterator[pa.RecordBatch]:
            points = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, words)
            member, root = links_within(points, radius)
            if len(member):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fps[i] for i in member], pa.binary()), pa.array([fps[i] for i in root], pa.binary())], names=["a", "b"]
                )

        last, kept = None, []
        for batch in batches:
            shard, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_pylist()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(cell) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                if s == e:
                    continue
                if last != (key := (int(shard[s]), int(cell[s]))):
                    if len(kept) > 1:
                        yield from linked(kept)
                    last, kept = key, []
                kept += fps[s:e]
        if len(kept) > 1:
            yield from linked(kept)

    dealt = cells.repartition(partitions(distinct.sparkSession), "shard", "cell").sortWithinPartitions("shard", "cell", "fp")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, size: int = 4,
    radius: int = 4, masks: int = 5, bits: int = 13, limit: int = 1 << 16,
) -> DataFrame:
    """One row per input row: _row, id, fp, component_id, first.

    component_id is the smallest id that links reach, the row's own included; null ids
    count only where a component has no other. `first` marks one row of each component:
    a row with that id, the first of several. Null, empty and blank texts have fingerprint
    zero and are linked like any other. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    base = written(
        source.withColumn("fp", simhash(width, size)("_text")).drop("_text").withColumn("_row", F.monotonically_increasing_id())
    )
    distinct = _heads(base)
    return _classed(base, distinct, components(near_links(distinct, width, radius, masks, bits, limit)))


def _heads(base: DataFrame) -> DataFrame:
    return written(base.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("head")))


def _classed(base: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """`base` with component_id and first, from the (node, root) of its linked fingerprints."""
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a table of its own, so that the join below is one of plain exchanges and a hot root can be split
    heads = written(rooted.groupBy("root").agg(F.min("head").alias("_head")))
    classes = rooted.join(heads, "root").select(
        F.col("fp").alias("_fp"), F.col("_head.id").alias("component_id"), F.col("_head._row").alias("_first")
    )
    return base.join(classes, F.col("fp") == F.col("_fp")).select(
        *base.columns, "component_id", (F.col("_first") == F.col("_row")).alias("first")
    )


def _often(docs: DataFrame, text_col: str, size: int, texts: int = 16_384, keys: int = 1_000_000, least: int = 2) -> np.ndarray:
    """Shingles that at least `least` of about `texts` sampled texts hold, the `keys` most frequent of them, rarest first.

    They only set an order; what the sample misses costs time and loses no link.
    """
    gap = max(1, math.ceil(docs.count() / texts))
    drawn = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(gap)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, size)).view(np.int64))], names=["key"])

    counts = drawn.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "key").limit(keys).toArrow()
    return rows["key"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _shingled(docs: DataFrame, size: int, similarity: float, often: np.ndarray, width: int = 64) -> DataFrame:
    """`docs` (column _text) with _sim (SimHash), fp (digest of the shingle set), _n (its size), _keys (its first shingles) and _sketch.

    A bit of the sketch is the parity of the shingles that fall on it, so two sketches
    differ in at most as many bits as the sets do in shingles: what it rules out is no link.
    It has a bit a shingle at least, so unlike sets of any size differ in too many.
    """
    rank = np.argsort(often)
    sent = docs.sparkSession.sparkContext.broadcast((often[rank], rank))
    kind = pa.struct([("sim", pa.binary()), ("fp", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("folded", pa.list_(pa.int64()))])

    def first(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hot, place = sent.value
        for batch in texts:
            out = []
            every = [shingle_hashes(text, size) for text in as_bytes(batch)]
            for hashes, sim in zip(every, majorities(every, width)):
                held = np.unique(hashes)
                n = len(held)
                order = held
                if n and len(hot):
                    at = np.minimum(np.searchsorted(hot, held), len(hot) - 1)
                    late = np.where(hot[at] == held, place[at], -1)
                    order = held[np.argsort(late, kind="stable")]
                few = order[: n - math.ceil(similarity * n - 1e-9) + 1] if n else order
                bits = max(256, 1 << (n - 1).bit_length()) if n else 256
                odd = np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
                folded = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
                out.append({"sim": sim, "fp": xxhash.xxh3_128_digest(held.tobytes()), "n": n, "keys": few.view(np.int64).tolist(), "sketch": sketch.tolist(), "folded": folded.tolist()})
            yield pa.array(out, kind)

    first.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = arrow_udf(first, "struct<sim: binary, fp: binary, n: int, keys: array<bigint>, sketch: array<bigint>, folded: array<bigint>>").asNondeterministic()
    found = docs.withColumn("_s", udf("_text")).drop("_text")
    parts = (F.col("_s.sim").alias("_sim"), F.col("_s.fp").alias("fp"), F.col("_s.n").alias("_n"), F.col("_s.keys").alias("_keys"))
    parts += (F.struct(F.col("_s.sketch").alias("sketch"), F.col("_s.folded").alias("folded")).alias("_sketch"),)
    return found.select(*(c for c in found.columns if c != "_s"), *parts)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their first column those whose key another row has too."""
    held = None  # the last row so far, and whether the one before it has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held[0], batch])
        keys = batch.column(0).to_numpy()
        same = keys[1:] == keys[:-1]
        keep = np.zeros(len(keys), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None:
            keep[0] |= held[1]
        keep_last, keep[-1] = bool(keep[-1]), False
        yield batch.filter(pa.array(keep))
        held = (batch.slice(len(keys) - 1), keep_last)
    if held is not None and held[1]:
        yield held[0]


def _similar(similarity: float):
    """Column function: whether two sets, as sorted hashes, have at least that Jaccard similarity."""

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ones, twos in parts:
            out = []
            for one, two in zip(ones, twos):
                a, b = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                both = np.sort(np.concatenate((a, b)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                out.append(shared >= similarity * (len(a) + len(b) - shared) - 1e-9)
            yield pa.array(out, pa.bool_())

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(run, "boolean").asNondeterministic()


def sketch_distance(one, two):
    """Bits in which two sketches differ, the longer one folded: no more than the sets differ in.

    Column function over structs of a sketch and its two halves laid over each other. Sets
    of like size have sketches of equal length, or one of twice the other's.
    """

    def bits(x, y):
        differ = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return F.aggregate(differ, F.lit(0), lambda total, n: total + n)

    x, y = F.size(one["sketch"]), F.size(two["sketch"])
    return (
        F.when(x == y, bits(one["sketch"], two["sketch"])).when(x == 2 * y, bits(one["folded"], two["sketch"]))
        .when(y == 2 * x, bits(one["sketch"], two["folded"])).otherwise(0)
    )


def fingerprint_pairs(base: DataFrame, distinct: DataFrame, width: int, radius: int, masks: int, bits: int) -> DataFrame:
    """(a, b) rows that the trees link: of unlike shingle sets with SimHashes (column _sim) within `radius`, a spanning forest."""
    heads = distinct.select(F.col("head._row").alias("_row"))
    held = written(base.join(heads, "_row", "left_semi").select("_sim", F.col("_row").alias("a")))
    first = written(held.groupBy("_sim").agg(F.min("a").alias("b")))
    equal = held.join(first, "_sim").where("a != b").select("a", "b")
    met = near_links(first.select(F.col("_sim").alias("fp")), width, radius, masks, bits)
    one, two = (first.select(F.col("_sim").alias(f"{x}_sim"), F.col("b").alias(x)) for x in ("a", "b"))
    near = met.select(F.col("a").alias("a_sim"), F.col("b").alias("b_sim")).join(one, "a_sim").join(two, "b_sim")
    return written(equal.unionByName(near.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar_links(base: DataFrame, distinct: DataFrame, size: int, similarity: float, known: DataFrame) -> DataFrame:
    """(a, b) links among fingerprints that connect all sets of at least `similarity`, each verified on the sets.

    `base` has _row, fp, _n, _keys, _sketch and _doc_text; `distinct` has fp and a head with the _row that stands for it.
    `known` are the (a, b) rows that fingerprints link, a spanning forest; they are verified first, with the pairs of
    leaders. Where a pair of the forest fails, others of its tree may be similar: what the forest connects is a group
    that meets like the rows of a key, whole, since nothing comes before it. What meets under a key is two numbers a row: how many shingles its set has and how many
    come before the key. The first shingle that two sets share leaves them only what comes
    from there on, so sizes and places rule out most pairs; sketches then travel once for a
    pair, and sets for the pairs that sketches leave.
    """
    spark = base.sparkSession
    heads = distinct.select(F.col("head._row").alias("_row"))
    keyed = base.join(heads, "_row", "left_semi").select(
        F.posexplode("_keys").alias("pos", "key"), F.col("_row").alias("row"), F.col("_n").alias("n")
    ).select("key", "row", "n", "pos")
    dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key")
    connected = components(known).select(F.xxhash64(F.lit("tree"), "root").alias("key"), F.col("node").alias("row"))
    grouped = connected.join(base.select(F.col("_row").alias("row"), F.col("_n").alias("n")), "row")
    meets = written(
        dealt.mapInArrow(_met, "key long, row long, n int, pos int").unionByName(grouped.select("key", "row", "n", F.lit(0).alias("pos")))
    )

    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([np.unique(shingle_hashes(t, size)).tobytes() for t in as_bytes(batch)], pa.binary())

    hashed.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    texts = base.select(F.col("_row").alias("row"), "fp", "_doc_text")
    sketches = base.select(F.col("_row").alias("row"), F.col("_n").alias("n"), F.col("_sketch").alias("sketch"))

    def ends_of(pairs: DataFrame) -> DataFrame:
        # a table, so that its size is known: where it is small nothing else is shuffled
        return written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct())

    def near_ones(pairs: DataFrame) -> DataFrame:
        """Those of the (a, b) that their sketches leave."""
        pairs = written(pairs.distinct())
        held = sketches.join(ends_of(pairs), "row", "left_semi")
        one, two = (held.select(F.col("row").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
        most = (F.col("a_n") + F.col("b_n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        left = pairs.join(one, "a").join(two, "b").where(sketch_distance(F.col("a_sketch"), F.col("b_sketch")) <= most)
        return left.select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the (a, b) whose sets are similar; sets are made and moved for the rows of pairs only."""
        left = written(pairs)
        sets = written(texts.join(ends_of(left), "row", "left_semi").withColumn("set", arrow_udf(hashed, "binary").asNondeterministic()("_doc_text")).drop("_doc_text"))
        one, two = (sets.select(F.col("row").alias(x), F.col("fp").alias(f"{x}_fp"), F.col("set").alias(f"{x}_set")) for x in "ab")
        both = left.join(one, "a").join(two, "b")
        return written(both.where(_similar(similarity)("a_set", "b_set")).select("a", "b", "a_fp", "b_fp"))

    def fits(one: str, two: str):
        """Sizes, and places of the key, leave it open that the sets are similar and share nothing before it."""
        (x, p), (y, q) = ((F.col(f"{c}.n"), F.col(f"{c}.pos")) for c in (one, two))
        shared = (x + y) * (similarity / (1 + similarity)) - 1e-6
        return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-6) & (F.least(x - p, y - q) >= shared)

    at = F.struct("n", "pos")
    meets = meets.select("key", "row", at.alias("s"))

    def led(rows: DataFrame, *salts) -> DataFrame:
        """Per key the rows of the least hashes, one for each of the salts."""
        leaders = rows.groupBy("key").agg(*(F.min(F.struct(F.xxhash64(*salt, "row"), *(c for c in rows.columns if c != "key"))).alias(f"l{i}") for i, salt in enumerate(salts)))
        about = [("row", "leader"), ("s", "t"), ("root", "led_root")]
        each = F.array_distinct(F.array(*(F.struct(*(F.col(f"l{i}.{c}").alias(x) for c, x in about if c in rows.columns)) for i in range(len(salts)))))
        return leaders.select(F.col("key").alias("l_key"), F.inline(each))

    def star(rows: DataFrame, leaders: DataFrame, apart) -> DataFrame:
        met = rows.join(leaders, (F.col("key") == F.col("l_key")) & apart & fits("s", "t"))
        return met.select(F.least("row", "leader").alias("a"), F.greatest("row", "leader").alias("b"))

    def still_apart(links: DataFrame) -> DataFrame:
        """What meets under keys whose rows stand in more than one component, with the component.

        The others have nothing left to say, nor have keys whose rows were all leaders.
        """
        roots = written(components(links.select("a", "b")).select(F.col("node").alias("row"), "root"))
        rows = meets.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        mixed = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k")).where("x != y AND k > 2")
        return written(rows.join(mixed.select("key"), "key", "left_semi"))

    links = verified(near_ones(known.unionByName(star(meets, led(meets, *((F.lit(i),) for i in range(2))), F.col("row") != F.col("leader")))))
    apart = still_apart(links)
    # new leaders, others under each key: rows of one group that are unlike its first leaders join it through these
    for turn in range(ROUNDS):
        leaders = led(apart, *((F.lit(4 * turn + i), F.col("key")) for i in range(4)))
        found = verified(near_ones(star(apart, leaders, F.col("root") != F.col("led_root"))))
        links = links.unionByName(found)
        if found.count() * WORTH <= apart.select("row").distinct().count():
            break
        apart = still_apart(links)
    # sketches go along with what is left, so that documents which share a passage and no more make no pairs
    apart = apart.join(sketches.select("row", "sketch"), "row")
    one, two = (
        apart.select(F.col("key").alias(f"{x}_key"), F.col("row").alias(x), F.col("s").alias(f"{x}_s"), F.col("root").alias(f"{x}_root"), F.col("sketch").alias(f"{x}_sketch"))
        for x in "ab"
    )
    met = (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root"))
    most = (F.col("a_s.n") + F.col("b_s.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    near = sketch_distance(F.col("a_sketch"), F.col("b_sketch")) <= most
    more = verified(one.join(two, met & fits("a_s", "b_s") & near).select("a", "b").distinct())
    return links.unionByName(more).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))


def drop_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8,
    width: int = 64, radius: int = 4, masks: int = 5, bits: int = 13,
) -> DataFrame:
    """`docs` with one row of each group of near copies, all columns as they were.

    Near copies are texts whose sets of `size`-word shingles have Jaccard similarity of at
    least `similarity`, and what chains of such texts connect. All are found and no others.
    The vantage-point trees find the texts whose SimHash of these shingles differs in at most
    `radius` bits; similar texts that differ in more bits meet under the first shingles of their sets.
    All that the trees connect is compared until it is linked or met pair by pair, not their forest's pairs only.
    Every link is verified on the sets. Texts without words are one group, with fingerprint
    zero; an empty table gives an empty result.
    """
    often = _often(docs, text_col, size)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.struct("*").alias("_doc"))
    base = written(_shingled(source, size, similarity, often, width).withColumn("_row", F.monotonically_increasing_id()))
    distinct = _heads(base)
    alike = fingerprint_pairs(base, distinct, width, radius, masks, bits)
    links = similar_links(base.withColumn("_doc_text", F.col("_doc")[text_col]), distinct, size, similarity, alike)
    return _classed(base, distinct, components(links)).where("first").select("_doc.*")

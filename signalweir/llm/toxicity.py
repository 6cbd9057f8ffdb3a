"""Toxicity scores on text restored through a noisy channel.

Stretches that look disguised (digits or signs among letters, single letters set apart,
letters repeated) are read as character lattices: each sign may stand for the letters it is
drawn for, separators may vanish or part two words, a run of one letter may be one or two.
Viterbi search finds the few best readings of a whole stretch, however long, under a character
trigram model of the corpus and the channel's costs; each of their words counts. Plain words
have one reading, themselves.

The trigram model counts every document. Features are restored words and their beginnings,
so that an ending does not hide a stem. They are learned from labelled rows by greedy
covering: of the features that hardly ever stand in clean texts the one that explains most
toxic texts still in need of it is taken, until a feature explains too few. So words that
merely sit beside a toxic one in copies of one text win nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalweir.llm.common import free_name, give_back, held_out, written

#: Signs and the letters they are drawn for: fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "{": "c",
}
_SIGNS = re.escape("".join(LOOKS))
_APART = r"[ .\-_*~·]"
_LETTER = r"[^\W\d_]"
_INSIDE = rf"[\w{_SIGNS}*.\-]"
#: A stretch that may be disguised, of any length: single letters or signs set apart; signs among letters; a letter three times.
_ODD = re.compile(
    rf"(?<!\w)(?:[{_SIGNS}]|{_LETTER})(?:{_APART}+(?:[{_SIGNS}]|{_LETTER})(?!\w)){{2,}}"
    rf"|(?<!{_INSIDE})(?:({_LETTER})(?!\1\1))*+(?={_INSIDE}*?(?:[{_SIGNS}*.\-]\w|\d|_|({_LETTER})\2\2)){_INSIDE}{{2,}}"
)
_WORD = re.compile(rf"{_LETTER}{{3,}}")
_PREFIXES = (3, 4, 5, 6)
#: Letters that the trigram model tells apart; all others are one.
_ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâäãåçèéêëìíîïñòóôöõùúûüß")}
_SIDE = len(_ALPHABET) + 2
_EDGE = 0
READINGS = 4
#: The hash of a path's text: a polynomial modulo a prime.
_FACTOR, _MODULUS = 1_000_003, (1 << 61) - 1


def _index(c: str) -> int:
    return _ALPHABET.get(c, _SIDE - 1)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of letters, word edges included, of every text; the sides bound the table that reaches the driver."""
    points = np.full(0x3000, _EDGE, np.int64)
    for code in range(0x3000):
        c = chr(code).lower()
        if len(c) == 1 and c.isalpha():
            points[code] = _index(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIDE**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                codes = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4")
                ids = np.where(codes < 0x3000, points[np.minimum(codes, 0x2FFF)], _SIDE - 1)
                # white space in a row is one edge
                ids = ids[np.concatenate(([True], (ids[1:] != _EDGE) | (ids[:-1] != _EDGE)))]
                if len(ids) > 2:
                    grams = (ids[:-2] * _SIDE + ids[1:-1]) * _SIDE + ids[2:]
                    total += np.bincount(grams, minlength=_SIDE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])
        batch = text = codes = ids = grams = None
        give_back()

    rows = docs.select(F.col(text_col)).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SIDE**3)
    for r in rows:
        out[r.gram] = r["n"]
    return out.reshape(_SIDE, _SIDE, _SIDE)


class Channel:
    """Readings of disguised stretches under a trigram model."""

    def __init__(self, counts: np.ndarray):
        # trigrams smoothed by bigrams, those by letters
        one = counts.sum((0, 1)) + 0.5
        two = counts.sum(0)
        low = (two + 2 * one / one.sum()) / (two.sum(1, keepdims=True) + 2)
        self.cost = -np.log((counts + 4 * low) / (counts.sum(2, keepdims=True) + 4)).astype(np.float32)
        self.start = self.cost[:, _EDGE].mean(0)
        self.readings = lru_cache(1 << 16)(self._readings)

    def __getstate__(self) -> dict:
        return {"cost": self.cost, "start": self.start}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.readings = lru_cache(1 << 16)(self._readings)

    @staticmethod
    def lattice(stretch: str) -> list[list[tuple[str, float]]]:
        """Per place what it may stand for and what the channel takes for it; '' vanishes, ' ' is a word edge."""
        places = []
        for run in re.finditer(r"(.)\1*", stretch.lower(), re.S):
            c, n = run[1], len(run[0])
            letters = [(c, 0.0)] if c.isalpha() else [(x, 1.0) for x in LOOKS.get(c, "")]
            gone = [] if letters and c.isalnum() else [("", 0.5)]
            edge = [(" ", 0.0 if c.isspace() else 0.5)] if not letters else []
            if n == 1:
                places.append(letters + gone + edge)
            else:
                one, two = (0.0, 1.0) if n > 2 else (0.7, 0.0)
                places.append([(x, p + one) for x, p in letters + gone] + [(x + x, p + two) for x, p in letters] + edge)
        return places

    def _readings(self, stretch: str) -> tuple[str, ...]:
        """The best READINGS ways to read the stretch, as words with single spaces.

        Costs depend on the last two letters, so the best READINGS texts that end in each pair of
        them are all that a longer reading can build on; pairs are bounded by the alphabet. A path
        is a cost, the hash of its text and a chain of letters back to the start.
        """
        ends: dict[tuple[int, int], list[tuple]] = {(_EDGE, _EDGE): [(0.0, 0, None)]}
        for options in self.lattice(stretch):
            after: dict[tuple[int, int], list[tuple]] = {}
            for (a, b), paths in ends.items():
                for letters, price in options:
                    x, y, more, added = a, b, price, ""
                    for c in letters:
                        if c == " ":
                            if y == _EDGE:
                                continue
                            more += float(self.cost[x, y, _EDGE])
                            x = y = _EDGE
                        else:
                            k = _index(c)
                            more += float(self.start[k] if y == _EDGE else self.cost[x, y, k])
                            x, y = y, k
                        added += c
                    into = after.setdefault((x, y), [])
                    for path in paths:
                        node = path[1], path[2]
                        for c in added:
                            node = (node[0] * _FACTOR + ord(c)) % _MODULUS, (node[1], c)
                        into.append((path[0] + more, *node))
            ends = {state: _few(paths) for state, paths in after.items()}
        last = [(p[0] + (float(self.cost[a, b, _EDGE]) if b != _EDGE else 0.0), *p[1:]) for (a, b), paths in ends.items() for p in paths]
        words = dict.fromkeys(_spelt(chain).strip() for _, _, chain in _few(last, 2 * READINGS))
        return tuple([w for w in words if w][:READINGS])

    def restored(self, text: str) -> list[str]:
        """The words that the disguised stretches of a text read as."""
        found: dict[str, None] = {}
        for m in _ODD.finditer(text):
            if any(c.isalpha() for c in m[0]):
                # long stretches hardly ever come twice
                for reading in self.readings(m[0]) if len(m[0]) <= 64 else self._readings(m[0]):
                    found.update(dict.fromkeys(reading.split(" ")))
        return list(found)


def _few(paths: list[tuple], n: int = READINGS) -> list[tuple]:
    """The n cheapest paths of different texts, cheapest first."""
    best: dict[int, tuple] = {}
    for path in sorted(paths, key=lambda p: (p[0], p[1])):
        if len(best) == n:
            break
        best.setdefault(path[1], path)
    return list(best.values())


def _spelt(chain: tuple | None) -> str:
    letters = []
    while chain:
        chain, c = chain
        letters.append(c)
    return "".join(reversed(letters))


def features(text: str, channel: Channel) -> set[str]:
    """`=word` of each restored or plain word, and its beginnings."""
    words = set(_WORD.findall(text.lower()))
    words.update(channel.restored(text))
    out = {"=" + w for w in words}
    for n in _PREFIXES:
        out |= {w[:n] for w in words if len(w) > n}
    return out


def _features_udf(channel: Channel, wanted=None):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only = None if wanted is None else wanted.value
        for batch in texts:
            out = [features(t or "", channel) for t in batch.to_pylist()]
            yield pa.array([sorted(f if only is None else f & only) for f in out], pa.list_(pa.string()))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<string>").asNondeterministic()


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    toxic_rows: int = 4000, clean_rows: int = 12000, candidates: int = 200_000, min_texts: int = 4, max_clean: float = 0.02, seed: int = 11,
) -> dict:
    """A model from the labelled rows that are not held out.

    Bound of the sample: about `toxic_rows` toxic and `clean_rows` clean distinct texts, by a
    hash of the text; of their features the `candidates` most frequent among toxic texts.
    Without toxic rows the model scores every text as clean. Null labels and texts teach nothing.
    """
    channel = Channel(trigram_counts(docs, text_col))
    # one row an id, so that repeated labels cannot outgrow the sample's bound; an id with both labels teaches nothing
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("y"), F.max(F.col(label_col).cast("int")).alias("_z"))
        .where("y = _z").drop("_z")
    )
    sizes = {r.y: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = {"channel": channel, "weights": {}, "bias": -4.0}
    if not sizes.get(1):
        return model
    gaps = {1: max(1, math.ceil(sizes[1] / toxic_rows)), 0: max(1, math.ceil(sizes.get(0, 0) / clean_rows))}
    drawn = marks.where(
        F.pmod(F.xxhash64(F.lit(seed), "_id"), F.when(F.col("y") == 1, F.lit(gaps[1])).otherwise(F.lit(gaps[0]))) == 0
    )
    # ids and labels only, as many as the sample's bound says: the texts of all others stay where they are
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(drawn), "_id")
    # equal texts teach once; a text with both labels is left out
    rows = written(rows.groupBy("text").agg(F.min("y").alias("y"), F.max("y").alias("_z")).where("y = _z").drop("_z"))
    texts_of = {r.y: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = texts_of.get(1, 0), texts_of.get(0, 0)
    toxic = rows.where("y = 1").select(_features_udf(channel)("text").alias("f"))
    counts = toxic.select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts)
    named = {r.f: r["n"] for r in counts.orderBy(F.desc("n"), "f").limit(candidates).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(named))
    clean = rows.where("y = 0").select(F.explode(_features_udf(channel, sent)("text")).alias("f"))
    beside = {r.f: r["n"] for r in clean.groupBy("f").agg(F.count("*").alias("n")).collect()}
    pure = {f for f, n in named.items() if beside.get(f, 0) * n_toxic <= max_clean * n * n_clean}
    only = docs.sparkSession.sparkContext.broadcast(frozenset(pure))
    texts = [frozenset(r.f) for r in rows.where("y = 1").select(_features_udf(channel, only)("text").alias("f")).collect()]
    model["weights"] = _cover(texts, pure, beside, n_clean, min_texts, gaps[1], gaps[0])
    rest = sum(not (t & model["weights"].keys()) for t in texts)
    model["bias"] = math.log((rest * gaps[1] + 0.5) / (n_clean * gaps[0] + 1))
    return model


def _cover(
    texts: list[frozenset], pure: set[str], beside: dict[str, int], n_clean: int, least: int, per_toxic: int, per_clean: int,
    times: int = 5, share: float = 0.05,
) -> dict[str, float]:
    """Features that explain toxic texts, with the log odds that they give a text.

    The feature that stands in most texts not explained `times` times yet is taken next, less
    a price for the clean texts it stands in; features of the same word then go.  One must
    explain `least` texts that nothing did before, or a `share` of all: so words that come
    together are all found, but not what a few copies have in common.  Two clean texts more
    than were seen stand against each; one whose odds stay below even is not taken.
    """
    holds: dict[str, set[int]] = {}
    for i, t in enumerate(texts):
        for f in t & pure:
            holds.setdefault(f, set()).add(i)
    total = {f: len(v) for f, v in holds.items()}
    price = {f: 8 * beside.get(f, 0) * len(texts) / max(1, n_clean) for f in holds}
    left = [times] * len(texts)

    def rank(f: str) -> tuple:
        # of equal ones the longest says most: a whole word before a beginning
        return (price[f] - len(holds[f]), not f.startswith("="), -len(f), f)

    queue = [rank(f) for f in holds]
    heapify(queue)
    weights: dict[str, float] = {}
    while queue:
        entry = heappop(queue)
        best = entry[-1]
        if any(_same_word(best, w) for w in weights):
            continue
        holds[best] = {i for i in holds[best] if left[i]}
        if (now := rank(best)) != entry:  # explained meanwhile: back to where it stands now
            if len(holds[best]) >= least:
                heappush(queue, now)
            continue
        fresh = sum(left[i] == times for i in holds[best])
        odds = total[best] * per_toxic / ((beside.get(best, 0) + 2) * per_clean)
        if odds > 1 and (fresh >= least or len(holds[best]) >= max(least, share * len(texts))):
            weights[best] = math.log(odds)
            for i in holds[best]:
                left[i] -= 1
    return weights


def _same_word(one: str, two: str) -> bool:
    one, two = one.removeprefix("="), two.removeprefix("=")
    return one.startswith(two) or two.startswith(one)


def toxicity(text: Column, model: dict) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts score as texts without any feature."""
    weights, bias, channel = model["weights"], min(model["bias"], -0.5), model["channel"]
    words = {f[1:]: w for f, w in weights.items() if f[0] == "="}
    stems = {f: w for f, w in weights.items() if f[0] != "="}
    whole, begun = ("|".join(re.escape(f) for f in sorted(x, key=lambda f: (-len(f), f))) for x in (words, stems))
    parts = [p for p in (rf"(?:{whole})(?!{_LETTER})" if whole else "", rf"(?:{begun})(?={_LETTER})" if begun else "") if p]
    find = re.compile(rf"(?<!{_LETTER})(?:{'|'.join(parts)})") if parts else None

    def weight(word: str) -> float:
        return max([words.get(word, 0.0), *(stems.get(word[:n], 0.0) for n in _PREFIXES if len(word) > n)])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                best = [0.0]
                if text and find:
                    best += [words.get(m, 0.0) or stems.get(m, 0.0) for m in set(find.findall(text.lower()))]
                    best += [weight(r) for r in channel.restored(text)]
                first, second = sorted([0.0, *best])[:-3:-1]
                logit = first + 0.2 * second if first > 0 else bias
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            yield pa.array(out, pa.float64())
        batch = text = None
        give_back()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "double").asNondeterministic()(text)


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Repeated rows each count; an empty table gives an empty result."""
    return docs.select(F.col(id_col).alias("id"), toxicity(F.col(text_col), model).alias("score"))


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more, columns as they were, whatever their names."""
    score = free_name(docs, "_toxicity")
    return docs.withColumn(score, toxicity(F.col(text_col), model)).where(F.col(score) < threshold).drop(score)

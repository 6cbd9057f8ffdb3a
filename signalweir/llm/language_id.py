"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte runs of three and four of the lower-cased text are hashed to buckets, each with an
embedding; a text is the mean of its runs' embeddings, and a linear layer with softmax over
it gives the languages. Both layers are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows per language; their sparse bucket counts, which
the number of buckets bounds however long a text, are made where the rows are. A temperature
fitted on a part that training leaves out calibrates the probabilities, and a threshold from
the same part tells which answers to reject.

For prediction both layers fold into one table of bucket by language, so a text costs one
look-up a byte run, over the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalweir.llm.common import LOWER_TABLE, as_bytes, held_out

BUCKETS, DIMS, CHUNK = 1 << 15, 16, 1 << 18
_LETTER = regex.compile(r"\p{L}")
#: ASCII but letters becomes a space; other bytes stay.
_SOUNDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_TABLE)


def buckets_of(data: bytes) -> Iterator[np.ndarray]:
    """Bucket of every byte run of three and four, in stretches of bounded size."""
    data = b" " + data.translate(_SOUNDS) + b" "
    for at in range(0, max(1, len(data) - 2), CHUNK):
        b = np.frombuffer(data[at : at + CHUNK + 3], np.uint8).astype(np.uint32)
        if len(b) < 3:
            return
        three = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1]) * np.uint32(0x01000193) ^ b[2:]
        four = three[:-1] * np.uint32(0x01000193) ^ b[3:] ^ np.uint32(0x55555555)
        yield (np.concatenate((three[:CHUNK], four[:CHUNK])) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def _counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        out = []
        for data in as_bytes(batch):
            total = np.zeros(BUCKETS, np.float32)
            for h in buckets_of(data):
                total += np.bincount(h, minlength=BUCKETS)
            some = np.flatnonzero(total)
            out.append({"at": some.astype("<u2").tobytes(), "n": total[some].astype("<f4").tobytes()})
        yield pa.array(out, pa.struct([("at", pa.binary()), ("n", pa.binary())]))


_counts.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800,
    languages: int = 512, epochs: int = 4, seed: int = 3,
) -> dict:
    """A model from the rows that are not held out and have a language.

    Bound of the sample: about `per_language` rows (by a hash of the id, so evenly) of each
    of the `languages` most frequent languages. No such rows give a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    names = sorted(sizes)
    if not names:
        return {"names": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0), "heat": 1.0, "floor": 0.0}
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(max(1, math.ceil(sizes[n] / per_language))))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id", "text"), share[F.col("lang")]) == 0)
    counted = chosen.select("id", "lang", arrow_udf(_counts, "struct<at:binary,n:binary>")("text").alias("c")).select("id", "lang", "c.*")
    number = {n: i for i, n in enumerate(names)}
    # a fixed order, so that the same rows give the same model
    got = sorted(counted.collect(), key=lambda r: (str(r.id), bytes(r.at), bytes(r.n)))
    data = [(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.n, "<f4"), number[r.lang]) for r in got]
    rng = np.random.default_rng(seed)
    data = [data[i] for i in rng.permutation(len(data)) if len(data[i][0])]
    aside = max(1, len(data) // 5) if len(data) >= 10 else 0
    return _train(data[aside:], data[:aside], names, epochs, rng)


def _train(data: list, aside: list, names: list[str], epochs: int, rng) -> dict:
    embed = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS))
    head, bias = np.zeros((DIMS, len(names))), np.zeros(len(names))
    steps, done = max(1, epochs * len(data)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, n, y = data[i]
            rate = 0.5 * (1 - done / steps)
            w = (n / n.sum())[:, None]
            x = (embed[at] * w).sum(0)
            p = _softmax(x @ head + bias)
            p[y] -= 1
            back = head @ p
            head -= rate * np.outer(x, p)
            bias -= rate * 0.1 * p
            embed[at] -= rate * len(at) ** 0.5 * w * back
            done += 1
    table = (embed @ head).astype(np.float32)
    model = {"names": names, "table": table, "bias": bias, "heat": 1.0, "floor": 0.0}
    if aside:
        logits = np.array([(table[at] * (n / n.sum())[:, None]).sum(0) + bias for at, n, _ in aside])
        truth = np.array([y for *_, y in aside])
        heats = np.geomspace(0.02, 20, 61)
        losses = [-np.log(np.maximum(_softmax(logits * h)[np.arange(len(truth)), truth], 1e-12)).mean() for h in heats]
        model["heat"] = float(heats[int(np.argmin(losses))])
        p = _softmax(logits * model["heat"])
        right, best = p.argmax(1) == truth, p.max(1)
        # the least confidence above which 99 of 100 answers set aside are right
        order = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1))
        model["floor"] = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def language(text: Column, model: dict) -> Column:
    """struct(lang, score, rejected) of a text column; `und`, 0 and rejected where it is null or has no letter."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, names = model["table"], model["names"]
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                if not names or not text or not _LETTER.search(text):
                    out.append({"lang": "und", "score": 0.0, "rejected": True})
                    continue
                total, n = np.zeros(len(names)), 0
                for h in buckets_of(text.encode()):
                    total += table[h].sum(0, dtype=np.float64)
                    n += len(h)
                p = _softmax((total / n + model["bias"]) * model["heat"])
                best = int(p.argmax())
                out.append({"lang": names[best], "score": float(p[best]), "rejected": bool(p[best] < model["floor"])})
            yield pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "struct<lang:string,score:double,rejected:boolean>").asNondeterministic()(text)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang, score, rejected. Repeated rows each count; an empty table gives none."""
    return docs.select(F.col(id_col).alias("id"), language(F.col(text_col), model).alias("p")).select("id", "p.*")

"""Packing by vector bin packing with the dot-product heuristic.

Examples are placed under three limits at once: tokens, segments and loss-bearing tokens of
a sequence. The open sequence's remaining room is a vector; of the pieces that fit, the one
with the largest weighted dot product with that room goes in next, so a piece that is large
where room is left wins and no single limit runs out early. Where no whole piece fits, one
is cut to fill the sequence exactly; runs of a full sequence's length are cut off whole.

Packing is local to an input partition, so nothing is shuffled and no key can be hot; what
a partition leaves open at its end is cut into sequences of a power of two, which need no
padding. A retried task reads the same rows and gives the same sequences.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

END_ID = 1
#: Distinct chunks whose ids a worker remembers; beyond it starts anew.
MEMORY = 400_000


def tokenizer(path: str, added: dict[str, int] | None = None) -> Callable[[str], bytes]:
    """Text to ids, as little-endian unsigned 32-bit bytes, by the ranks file at `path`.

    Texts are cut at the `added` tokens, which have ids of their own, wherever they stand.

    The split pattern always cuts before a single space that a non-space follows, so a text
    without double spaces is the ids of its space-separated chunks, and those repeat.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
    known_tokens = tuple(added or ())

    def ids(text: str) -> bytes:
        return np.array(coder.encode_ordinary(text), "<u4").tobytes()

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = found = ids(" " + chunk)
            return found

    known = Chunks()

    def encode(text: str) -> bytes:
        if any(token in text for token in known_tokens):
            return np.array(coder.encode(text, allowed_special="all"), "<u4").tobytes()
        head, *rest = text.split(" ")
        if "" in rest or not head:
            return ids(text)
        # a chunk that starts with other white space keeps its space apart only within the whole text
        if any(c[0].isspace() for c in rest):
            return ids(text)
        return ids(head) + b"".join(map(known.__getitem__, rest))

    return encode


class Packer:
    """Fills one sequence after another from a pool of pieces.

    A piece is (key, start, ids, loss): `loss` flags its loss-bearing tokens, None for all.
    Every id lands in exactly one piece; only `cut` pieces are divided.
    """

    POOL = 2048

    def __init__(self, size: int, max_segments: int, max_loss: int, first_id: int):
        self.size, self.limits = size, np.array([size, max_segments, max_loss], float)
        self.sequence = first_id
        self.pool: list = []
        self.needs = np.zeros((self.POOL, 3))

    def add(self, key, ids: bytes, loss: np.ndarray | None) -> Iterator[tuple]:
        n = len(ids) // 4
        at = 0
        while n - at >= self.size and self.limits[2] >= self.size:  # whole sequences
            yield key, at, ids[4 * at : 4 * (at + self.size)], self._next(), 0
            at += self.size
        if at < n:
            while len(self.pool) == self.POOL:
                yield from self._sequence(self.size)
            self._put(key, at, ids[4 * at :], None if loss is None else loss[at:])

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _put(self, key, start: int, ids: bytes, loss) -> None:
        n = len(ids) // 4
        self.needs[len(self.pool)] = n, 1, n if loss is None else loss.sum()
        self.pool.append((key, start, ids, loss))

    def _take(self, i: int):
        piece, last = self.pool[i], len(self.pool) - 1
        self.pool[i], self.needs[i] = self.pool[last], self.needs[last]
        self.pool.pop()
        return piece

    def _sequence(self, size: int) -> Iterator[tuple]:
        """Fill one sequence of at most `size` tokens; where segments or loss run out before, it ends at a power of two."""
        placed = list(self._filled(size))
        used = sum(len(p[2]) // 4 for p in placed)
        over = 0 if used in (0, self.size) else used - (1 << (used.bit_length() - 1))
        for (key, start, ids, sequence, offset), loss in zip(reversed(placed), reversed(self._losses)):
            if not over:
                break
            placed.pop()
            n = len(ids) // 4
            keep = max(0, n - over)
            over -= n - keep
            if self.pool and self.pool[-1][0] is key and self.pool[-1][1] == start + n:  # what was cut off goes back with it
                *_, more, flags = self._take(len(self.pool) - 1)
                ids, loss = ids + more, None if loss is None else np.concatenate([loss, flags])
            self._put(key, start + keep, ids[4 * keep :], None if loss is None else loss[keep:])
            if keep:
                placed.append((key, start, ids[: 4 * keep], sequence, offset))
        yield from placed

    def _filled(self, size: int) -> Iterator[tuple]:
        """The pieces of one sequence; `_losses` has their flags."""
        self._losses: list = []
        room, offset, sequence = np.minimum(self.limits, [size, np.inf, np.inf]), 0, self._next()
        while self.pool and room[0] >= 1 and room[1] >= 1:
            needs = self.needs[: len(self.pool)]
            fits = (needs <= room).all(axis=1)
            score = np.where(fits, (needs / self.limits) @ (room / self.limits), -1)
            i = int(score.argmax())
            if score[i] >= 0:
                key, start, ids, loss = self._take(i)
            else:  # none fits whole: cut the longest at what the room allows
                i = int(needs[:, 0].argmax())
                key, start, ids, loss = self._take(i)
                bearing = np.arange(1, len(ids) // 4 + 1) if loss is None else np.cumsum(loss)
                n = min(int(room[0]), int(np.searchsorted(bearing, room[2], side="right")))
                if n:
                    self._put(key, start + n, ids[4 * n :], None if loss is None else loss[n:])
                    ids, loss = ids[: 4 * n], None if loss is None else loss[:n]
                else:
                    self._put(key, start, ids, loss)
                    return
            n = len(ids) // 4
            self._losses.append(loss)
            yield key, start, ids, sequence, offset
            offset += n
            room -= n, 1, n if loss is None else loss.sum()

    def close(self) -> Iterator[tuple]:
        """Place what is left: full sequences, then sequences of falling powers of two."""
        while self.pool:
            left = int(self.needs[: len(self.pool), 0].sum())
            yield from self._sequence(self.size if left >= self.size else 1 << (left.bit_length() - 1))


def pack(
    examples: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
    size: int = 2048, max_segments: int = 512, max_loss: int | None = None, added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    An example is the ids of its text and END_ID; null texts are empty, so every example has
    an id at least, and repeated rows are packed again. With `loss_col` (boolean) the tokens
    of examples where it is not true bear no loss; without it all do. `added` names the
    vocabulary's added tokens with their ids. An empty table gives
    an empty result. Extra columns are not read.
    """
    most = size if max_loss is None else max_loss
    if min(size, max_segments, most) < 1:
        raise ValueError("size, max_segments and max_loss must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary, added)
        packer = Packer(size, max_segments, most, TaskContext.get().partitionId() << 40)

        def rows(pieces) -> pa.RecordBatch | None:
            got = list(pieces)
            if not got:
                return None
            key, start, ids, sequence, offset = zip(*got)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in key], kind), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([k[1] for k in key], pa.int64()), pa.array(sequence, pa.int64()),
                 pa.array(offset, pa.int64())],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        kind = None
        for batch in batches:
            kind = batch.column(0).type

            def each(batch=batch):
                for key, text, bears in zip(*(c.to_pylist() for c in batch.columns)):
                    ids = encode(text or "") + b"\x01\x00\x00\x00"
                    n = len(ids) // 4
                    yield from packer.add((key, n), ids, None if bears else np.zeros(n, bool))

            if (out := rows(each())) is not None:
                yield out
        if kind is not None and (out := rows(packer.close())) is not None:
            yield out

    bears = F.lit(True) if loss_col is None else F.coalesce(F.col(loss_col), F.lit(False))
    rows = examples.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), bears.alias("bears"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )

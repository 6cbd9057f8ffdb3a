"""Repair of conversation structure at least cost, over a suffix-shared automaton.

Within a conversation each row becomes a letter: the class of its role and its first fault.
The string of letters is the conversation's signature, and everything that the cheapest
repair depends on. Signatures are minimised from the end: distinct ones are range-partitioned
and sorted by their reversed letters, so that a signature shares the nodes of the longest
suffix it has in common with the one before it, and nodes that differ neither in what each
state of the grammar still costs (beyond the cheapest) nor in the edit it asks for are one
node of the automaton. Costs and edits are worked out once for a node and a letter before
it, across all conversations; a signature is a path of nodes, and its audit is read off
along that path. Whatever the lengths, a node's costs differ from each other by a few
inserts at most, so the automaton stays small and a task holds one path.

Nothing gathers a conversation: rows are range-partitioned by conversation and turn, so a
long one spans many tasks, each of which gives a piece of its signature. Only the repaired
rows themselves, which are one sequence by nature, stream through one task a conversation,
a row at a time, and blank and repeated rows stay out of that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.llm.common import partitions, written

BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. It may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled row leads to: the only one of u and a that may come next.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state that a kept row of each role leads to, None where the grammar has no such step.
STEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "o": (None,) * 4}
ROLE = {USER: "user", ASSISTANT: "assistant"}
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The letter of a row that must go: blank, or a role and text seen before.
GONE = "x"
FAULTS = ("blank", "duplicate", "truncated")


class Automaton:
    """Nodes are (costs beyond the cheapest, edits) by state; edges are worked out once each."""

    def __init__(self):
        # after the last row: an open turn needs an assistant, a system row both
        self.nodes: list[tuple] = [((0, 2 * INSERT, INSERT, 0), (None, "I", "I", None))]
        self._known = {self.nodes[0]: 0}
        self._edges: dict[tuple[int, str], tuple[int, int]] = {}

    def before(self, node: int, letter: str) -> tuple[int, int]:
        """The node of a suffix that a row precedes, and what the cheapest cost grows by."""
        found = self._edges.get((node, letter))
        if found is None:
            found = self._edges[node, letter] = self._solve(self.nodes[node][0], letter)
        return found

    def _solve(self, rest: tuple, letter: str) -> tuple[int, int]:
        # at equal cost the least letter wins; two edits of one row never share a letter
        best = [(DELETE + rest[q], "D") for q in range(4)]
        if letter != GONE:
            broken = TRUNCATED if letter.isupper() else 0
            for q in range(4):
                best[q] = min(best[q], (RE_ROLE + broken + rest[NEXT[q]], "R"))
                to = STEP[letter.lower()][q]
                if to is not None:
                    best[q] = min(best[q], (broken + rest[to], "K"))
        user, assistant = best[USER], best[ASSISTANT]
        best[USER] = min(user, (INSERT + assistant[0], "I"))
        best[ASSISTANT] = min(assistant, (INSERT + user[0], "I"))
        for q in (START, SYSTEM):
            best[q] = min(best[q], (INSERT + best[USER][0], "I"))
        least = min(cost for cost, _ in best)
        node = (tuple(cost - least for cost, _ in best), tuple(edit for _, edit in best))
        at = self._known.setdefault(node, len(self.nodes))
        if at == len(self.nodes):
            self.nodes.append(node)
        return at, least

    def audit(self, path: list[int], signature: str) -> str:
        """The edits of a signature whose suffixes have the nodes of `path`, shortest first."""
        edits, at, q = [], len(path) - 1, START
        while (edit := self.nodes[path[at]][1][q]) is not None:
            edits.append(edit)
            if edit == "I":
                q = NEXT[q]
                continue
            letter = signature[len(signature) - at]
            q = NEXT[q] if edit == "R" else STEP[letter.lower()][q] if edit == "K" else q
            at -= 1
        return "".join(edits)


def repairs(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each signature; the more suffixes neighbours share, the fewer nodes are walked."""
    automaton, path, total, last = Automaton(), [0], [0], ""
    for signature in signatures:
        shared = 0
        for a, b in zip(reversed(last), reversed(signature)):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :], total[shared + 1 :]
        for i in range(len(signature) - shared - 1, -1, -1):
            node, more = automaton.before(path[-1], signature[i])
            path.append(node)
            total.append(total[-1] + more)
        last = signature
        yield total[-1] + automaton.nodes[path[-1]][0][START], automaton.audit(path, signature)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Distinct rows of each conversation: conv, turn, role, text, m (how often), fault (null, or the first of FAULTS).

    Null roles and texts are one space. Of rows with equal role and text the first by turn
    (nulls first) has its own fault, the others are duplicates; so are the m - 1 repeats
    of a row, which the caller counts.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m"))
    said = rows.groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("n"))
    # only rows that come again are looked up, so that a text travels once
    again = said.where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("first.turn").alias("f"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    met = rows.join(again, same, "left")
    later = F.col("r").isNotNull() & ~F.col("turn").eqNullSafe(F.col("f"))
    core = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(core == "", "blank").when(later, "duplicate")
        .when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return met.select("conv", "turn", "role", "text", "m", fault.alias("fault"))


def _order(text: Column | str = "text") -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col(text) if isinstance(text, str) else text]


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation of turns(): conv, signature, blank, duplicate, truncated, illegal, gaps."""
    # a text's beginning is enough to split equal turns, and keeps the sampled borders small
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *_order(F.substring("text", 1, 64)))
    initial = F.substring("role", 1, 1)
    letters = dealt.sortWithinPartitions(*_order()).select(
        "conv", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"), "fault", "m", F.spark_partition_id().alias("slice")
    )
    kind = rows.schema["conv"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # conv, slice, letters, roles at its ends, illegal, faults

        def piece() -> pa.RecordBatch:
            conv, at, letters, first, last, illegal, faults = held
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((conv, at, "".join(letters), first, last, illegal, *faults), kinds)], names=names
            )

        names = ["conv", "slice", "signature", "head", "tail", "illegal", *FAULTS]
        for batch in batches:
            kinds = [batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.int64()] * 3]
            for conv, role, fault, m, at in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != conv:
                    if held is not None:
                        yield piece()
                    held = [conv, at, [], role, None, 0, [0, 0, 0]]
                elif held[4] + role not in ("su", "ua", "au"):
                    held[5] += 1
                held[4] = role
                held[5] += m - 1  # equal roles never follow each other
                if fault in ("blank", "duplicate"):
                    held[2].append(GONE * m)
                    held[6][FAULTS.index(fault)] += m
                else:
                    held[2].append((role.upper() if fault else role) + GONE * (m - 1))
                    held[6][1] += m - 1
                    held[6][2] += bool(fault)
        if held is not None:
            yield piece()

    fields = f"conv {kind}, slice int, signature string, head string, tail string, illegal long, {', '.join(f'{x} long' for x in FAULTS)}"
    found = written(letters.mapInArrow(pieces, fields))
    whole = found.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("slice", "signature", "head", "tail"))).alias("p"),
        F.sum("illegal").alias("illegal"), *(F.sum(x).alias(x) for x in FAULTS),
    )
    seams = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.element_at("p", i)["tail"], F.element_at("p", i + 1)["head"]))
    broken = F.when(F.size("p") > 1, F.size(F.filter(seams, lambda x: ~x.isin("su", "ua", "au")))).otherwise(0)
    spans = rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    ).withColumnRenamed("conv", "c")
    whole = whole.select("conv", F.array_join(F.transform("p", lambda p: p["signature"]), "").alias("signature"), *FAULTS, (F.col("illegal") + broken).alias("illegal"))
    return whole.join(spans, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def audits(distinct: DataFrame) -> DataFrame:
    """signature, cost and audit of each row of a table of distinct signatures."""
    turned = distinct.select("signature", F.reverse("signature").alias("turned"))
    dealt = turned.repartitionByRange(partitions(distinct.sparkSession), F.substring("turned", 1, 256)).sortWithinPartitions("turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def read() -> Iterator[str]:
            for batch in batches:
                for signature in batch.column(0).to_pylist():
                    waiting.append(signature)
                    yield signature

        out, size = [], 0
        for cost, audit in repairs(read()):
            out.append((waiting.pop(), cost, audit))
            size += len(audit)
            if len(out) == 1024 or size > 1 << 22:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["signature", "cost", "audit"])

    return dealt.select("signature").mapInArrow(run, "signature string, cost long, audit string")


class _Walk:
    """Applies an audit to the rows of one conversation as they come, and hands on what is left."""

    def __init__(self, signature: str, audit: str):
        self.signature, self.audit, self.i, self.j, self.q = signature, audit, 0, 0, START

    def until_row(self) -> Iterator[tuple[str, str, str]]:
        """Inserts before the next row that is there; rows that had to go are passed over."""
        while self.i < len(self.audit):
            if self.audit[self.i] == "I":
                self.q = NEXT[self.q]
                yield ROLE[self.q], "", "I"
            elif self.signature[self.j] == GONE:
                self.j += 1
            else:
                return
            self.i += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        edit, letter = self.audit[self.i], self.signature[self.j]
        self.i, self.j = self.i + 1, self.j + 1
        if edit == "K":
            self.q = STEP[letter.lower()][self.q]
            yield role, text, "K"
        elif edit == "R":
            self.q = NEXT[self.q]
            yield ROLE[self.q], text, "R"


def _streamed(rows: DataFrame, found: DataFrame, out: str, result) -> DataFrame:
    """Walks every conversation's rows in order; `result` makes Arrow batches of (conv, steps)."""
    heads = found.select("conv", F.lit(0).alias("h"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.col("signature").alias("role"), F.col("audit").alias("text"))
    body = rows.where("fault IS NULL OR fault = 'truncated'").select("conv", F.lit(1).alias("h"), "turn", "role", "text")
    dealt = heads.unionByName(body).repartition(partitions(rows.sparkSession), "conv")
    conv, *rest = _order()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, state, kind = None, None, None
        for batch in batches:
            kind = batch.column(0).type
            for conv, h, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if h:
                    yield from state.add(walk.until_row())
                    yield from state.add(walk.row(role, text))
                else:
                    if walk is not None:
                        yield from state.add(walk.until_row())
                        yield from state.close()
                    else:
                        state = result(kind)
                    walk = _Walk(role, text)
                    state.open(conv)
        if walk is not None:
            yield from state.add(walk.until_row())
            yield from state.close()
            yield from state.flush()

    return dealt.sortWithinPartitions(conv, "h", *rest).select("conv", "h", "role", "text").mapInArrow(run, out)


class _Batches:
    """Rows of a result, handed on in Arrow batches of bounded size."""

    names: list[str] = []
    kinds: list[pa.DataType] = []

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.size, self.conv = kind, [], 0, None

    def open(self, conv) -> None:
        self.conv = conv

    def put(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= 1024 or self.size > 1 << 22:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), [self.kind, *self.kinds])], names=["conv", *self.names])
        self.rows, self.size = [], 0


class _Rows(_Batches):
    names, kinds = ["pos", "role", "text", "edit"], [pa.int64(), pa.string(), pa.string(), pa.string()]

    def open(self, conv) -> None:
        super().open(conv)
        self.pos = 0

    def add(self, steps) -> Iterator[pa.RecordBatch]:
        for role, text, edit in steps:
            yield from self.put((self.conv, self.pos, role, text, edit), len(text))
            self.pos += 1

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class _Digests(_Batches):
    names, kinds = ["digest"], [pa.string()]

    def open(self, conv) -> None:
        super().open(conv)
        self.sum, self.sep = hashlib.sha256(), ""

    def add(self, steps) -> Iterator[pa.RecordBatch]:
        for role, text, _ in steps:
            self.sum.update(f"{self.sep}{role}:{text}".encode())
            self.sep = "\n"
        return iter(())

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.put((self.conv, self.sum.hexdigest()))


class Repair:
    """The cheapest repair of every conversation.

    Rows go by turn (nulls first), then role, then text; rows equal in all four columns are
    repeats of each other. Null ids are a conversation of their own, null roles and texts
    one space. A conversation of blank rows only is repaired to nothing; an empty table has
    no conversations. Other columns are not read.
    """

    def __init__(self, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self._rows = written(turns(conversations, conv_col, turn_col, role_col, text_col))
        found = written(signatures(self._rows))
        solved = audits(found.select("signature").distinct())
        self._found = written(found.join(solved, "signature"))

    def report(self) -> DataFrame:
        """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self._found.select("conv", "gaps", *FAULTS, "illegal", "cost", "audit")

    def rows(self) -> DataFrame:
        """The repaired conversations: conv, pos (from 0), role, text, edit (K, R or I)."""
        kind = self._rows.schema["conv"].dataType.simpleString()
        return _streamed(self._rows, self._found, f"conv {kind}, pos long, role string, text string, edit string", _Rows)

    def digests(self) -> DataFrame:
        """conv and the SHA-256 of its repaired `role:text` lines, joined by newlines."""
        kind = self._rows.schema["conv"].dataType.simpleString()
        return _streamed(self._rows, self._found, f"conv {kind}, digest string", _Digests)

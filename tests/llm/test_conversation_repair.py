"""Conversation repair: against a search over all edits, and row by row against plain Python."""

import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import pytest

from signalweir.llm import queries
from signalweir.llm.conversation_repair import NEXT, START, STEP, Repair, repairs

SF = "/root/testdata/sf0.01"


def cheapest(signature):
    """Least (cost, audit) by best-first search over whole edit strings; shares nothing with the automaton."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (at, roles) in done or len(roles) > 2 * len(signature) + 3:
            continue
        done.add((at, roles))
        ok = [r for r in "sua" if re.fullmatch("s?(ua)*u?", roles + r)]
        for r in ok:
            if r != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", at, roles + r))
        if at < len(signature):
            letter = signature[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if letter != "x":
                more = 3 * letter.isupper()
                if letter.lower() in ok:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + letter.lower()))
                for r in ok:
                    if r != "s":
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + r))


def test_automaton_equals_search():
    letters = "suaoSUAOx"
    every = ["".join(p) for n in range(5) for p in itertools.product(letters, repeat=n)]
    every = sorted(every[::3] + ["suauax" * 2, "aaaaaa", "ssssss", "uuuuuuu", "xxxxx", "oOoOo"], key=lambda s: s[::-1])
    assert list(repairs(iter(every))) == [cheapest(s) for s in every]


def expected(rows):
    """The contract in plain Python: rows of one conversation after damage, in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, letters, counts = set(), [], defaultdict(int)
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        r = role[:1] if role[:1] in tuple("sua") else "o"
        letters.append("x" if fault in ("blank", "duplicate") else r.upper() if fault else r)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest("".join(letters))
    out, left, q = [], iter(zip(rows, letters)), START
    for edit in audit:
        if edit == "I":
            q = NEXT[q]
            out.append(("user" if q == 2 else "assistant") + ":")
            continue
        (_, role, text), letter = next(left)
        if edit == "K":
            q = STEP[letter.lower()][q]
            out.append(f"{role}:{text}")
        elif edit == "R":
            q = NEXT[q]
            out.append(("user" if q == 2 else "assistant") + f":{text}")
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def order(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


def test_query_equals_plain_python(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        conv, turn, role, text = (" " if x is None else x for x in (r.conv_id, r.turn, r.role, r.text))
        how, rows = zlib.crc32(f"{conv}:{turn}".encode()) % 20, convs[r.conv_id]
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        rows += [(r.turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == {conv: expected(sorted(rows, key=order)) for conv, rows in convs.items()}
    assert len({v[6] for v in got.values()}) > 5


AWKWARD = [
    (None, 1, "user", "no id.", "x"), (None, 2, "assistant", "fine.", "x"),
    (1, None, None, None, "x"), (1, None, "user", "hello", "x"), (1, 3, "user", "hello", "x"), (1, 3, "user", "hello", "x"),
    (2, 1, "", "odd role.", "x"), (2, 1, "sysop", "ümlaut 🙂!", "x"), (2, 9, "user", "ends  ?\n ", "x"),
    (3, 1, "assistant", " \t", "x"), (3, 2, "assistant", "", "x"),
    (4, 1, "user", "long " * 50_000, "x"), (4, 1, "user", "long " * 50_000, "x"), (4, 2, "assistant", "yes.", None),
]


def test_awkward_rows(spark):
    given = spark.createDataFrame(AWKWARD, "conv_id long, turn long, role string, text string, slice string")
    convs = defaultdict(list)
    for conv, turn, role, text, _ in AWKWARD:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    repair = Repair(given)
    report = {r.conv: tuple(r)[1:] for r in repair.report().collect()}
    digests = {r.conv: r.digest for r in repair.digests().collect()}
    want = {conv: expected(sorted(rows, key=order)) for conv, rows in convs.items()}
    assert {k: (*v, digests[k]) for k, v in report.items()} == want
    lines = defaultdict(list)
    for r in sorted(repair.rows().collect(), key=lambda r: (r.conv is not None, r.conv or 0, r.pos)):
        lines[r.conv].append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(lines[k]).encode()).hexdigest() for k in report} == digests


def test_one_long_conversation(spark):
    """A conversation that spans every slice is pieced together."""
    roles = ["user", "assistant", "system", "user", "user", "assistant"]
    rows = [(7, i, roles[i * 7 % 6], f"text {i % 97}" + ("." if i % 5 else "")) for i in range(3000)]
    repair = Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = repair.report().collect()[0]
    plain = [(i, r, t) for _, i, r, t in rows]
    seen, letters = set(), ""
    for _, r, t in plain:
        letters += "x" if (r, t) in seen else r[0] if t[-1] == "." else r[0].upper()
        seen.add((r, t))
    assert (got.cost, got.audit) == next(repairs(iter([letters])))
    assert got.illegal == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))


def test_empty_table(spark):
    repair = Repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.report().count() == repair.rows().count() == repair.digests().count() == 0


@pytest.mark.parametrize("signature, want", [("", (0, "")), ("s", (4, "D")), ("u", (3, "KI")), ("sua", (0, "KKK")), ("x", (4, "D"))])
def test_by_hand(signature, want):
    assert next(repairs(iter([signature]))) == want

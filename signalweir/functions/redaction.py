"""Detection of secrets and personal data, where the rows lie.

Detectors run in order, each on the text the one before left behind.  A hit's captured
value is replaced by an interim token made from its hash; the tokens become numbered
placeholders once every hit of an incident is known (`operators.redaction`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalweir.functions.text import EDGE_L, EDGE_R, WS

OPEN, CLOSE = "«", "»"
TOKEN = f"{OPEN}[a-p]{{64}}{CLOSE}"
PLACEHOLDER = f"{OPEN}[A-Z_]+_[0-9]+{CLOSE}"
_NOT_WS = WS[1:-1]


@dataclass(frozen=True)
class Detector:
    kind: str
    value: str
    before: str = ""
    after: str = ""
    ignore_case: bool = False
    card: bool = False
    needs: str = ""  # text every match contains: a cheap test before the pattern

    @property
    def pattern(self) -> str:
        flag = "(?i)" if self.ignore_case else ""
        return f"{flag}({self.before})({self.value})({self.after})"


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_KEY_WORDS = "password|passwd|pwd|secret|token|key|credential|passphrase"

# The detectors in the order they run.
DETECTORS = [
    Detector("PRIVATE_KEY", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", needs="-----BEGIN "),
    Detector("JWT", r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", needs="eyJ"),
    Detector("AWS_KEY", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Detector("GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9]{20,}", needs="gh"),
    Detector("STRIPE_KEY", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", EDGE_L, needs="k_"),
    Detector("SLACK_TOKEN", r"xox[abeprs]-[A-Za-z0-9-]{10,}", EDGE_L, needs="xox"),
    Detector("SLACK_WEBHOOK", r"https://hooks\.slack\.com/services/[A-Za-z0-9_/+-]{20,}", needs="https://hooks.slack.com/"),
    Detector("GOOGLE_API_KEY", r"AIza[0-9A-Za-z_-]{35}", EDGE_L, r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=-)(?=[A-Za-z0-9_]))", needs="AIza"),
    Detector("LLM_API_KEY", r"sk-(?:ant-|proj-|svcacct-)?[A-Za-z0-9_-]{20,}", EDGE_L, needs="sk-"),
    Detector("GITLAB_TOKEN", r"glpat-[A-Za-z0-9_-]{20,}", EDGE_L, needs="glpat-"),
    Detector("NPM_TOKEN", r"npm_[A-Za-z0-9]{36}", EDGE_L, EDGE_R, needs="npm_"),
    Detector("SENDGRID_KEY", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", EDGE_L, needs="SG."),
    Detector("RESEND_KEY", r"re_[A-Za-z0-9_]{16,}", EDGE_L, EDGE_R, needs="re_"),
    Detector("BEARER", r"[A-Za-z0-9\-._~+/]{10,}=*", rf"[Bb]earer{WS}+", needs="earer"),
    Detector("PASSWORD", rf"[^@{_NOT_WS}/]+", rf"://[^:/@{_NOT_WS}]+:", "@", needs="://"),
    Detector(
        "SECRET",
        r"[A-Za-z0-9\-_./+=]{8,}",
        rf"{EDGE_L}(?:(?:[A-Za-z0-9]++[_-])*+(?:{_KEY_WORDS})|apikey|auth(?:orization)?)[\"']?{WS}*[:=]{WS}*[\"']?",
        ignore_case=True,
    ),
    Detector("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", needs="@"),
    Detector("SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", EDGE_L, EDGE_R, needs="-"),
    Detector(
        "CARD",
        r"(?:[0-9][ -]?){13,19}",
        EDGE_L,
        r"(?:(?<=[0-9])(?![A-Za-z0-9_])|(?<=[ -])(?=[A-Za-z0-9_]))",
        card=True,
    ),
    Detector("IP", rf"(?:{_OCTET}\.){{3}}{_OCTET}", EDGE_L, EDGE_R, needs="."),
]


def interim_token(value: Column) -> Column:
    """Letters only, so that no later detector can match inside it."""
    letters = F.translate(F.sha2(value, 256), "0123456789abcdef", "abcdefghijklmnop")
    return F.concat(F.lit(OPEN), letters, F.lit(CLOSE))


def card_number(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


HIT = "struct<detector:int,position:int,type:string,value:string>"
_SCAN = pa.struct([
    ("text", pa.binary()),
    ("hits", pa.list_(pa.struct([("detector", pa.int32()), ("position", pa.int32()), ("type", pa.string()), ("value", pa.string())]))),
])
_LETTERS = str.maketrans("0123456789abcdef", "abcdefghijklmnop")
_TAKEN = re.compile(f"{TOKEN}|{PLACEHOLDER}")
# the patterns name ASCII letters only, as the default of Java's does
_FINDERS = [(n, d.kind, re.compile(d.pattern, re.ASCII), d.needs, d.card) for n, d in enumerate(DETECTORS)]


def _is_card(value: str) -> bool:
    """`card_number` of one value."""
    digits = [int(c) for c in value if c in "0123456789"]
    doubled = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and doubled % 10 == 0


def scan_text(text: str) -> tuple[str, list[dict]]:
    """The text with interim tokens, and every hit in order of discovery."""
    hits: list[dict] = []
    for number, kind, pattern, needs, card in _FINDERS:
        if needs not in text:
            continue
        pieces, at = [], 0
        for position, match in enumerate(pattern.finditer(text)):
            value = match[2]
            if _TAKEN.fullmatch(value) or (card and not _is_card(value)):
                continue
            hits.append({"detector": number, "position": position, "type": kind, "value": value})
            token = hashlib.sha256(value.encode()).hexdigest().translate(_LETTERS)
            pieces += (text[at : match.start(2)], OPEN, token, CLOSE)
            at = match.end(2)
        if pieces:
            text = "".join((*pieces, text[at:]))
    return text, hits


def with_scan(texts: DataFrame, text: str, out: str) -> DataFrame:
    """Add struct<text, hits>: the text with interim tokens, and every hit in order of discovery."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for raw in batch.to_pylist():
                seen, hits = scan_text(raw.decode("utf-8", "replace")) if raw is not None else (None, [])
                # bytes that are no UTF-8 stay where nothing was found
                found.append({"text": seen.encode() if hits else raw, "hits": hits})
            yield pa.array(found, _SCAN)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scan = arrow_udf(run, f"struct<text:binary,hits:array<{HIT}>>").asNondeterministic()
    found = texts.withColumn(out, scan(F.col(text).cast("binary")))
    return found.withColumn(out, F.struct(F.col(out)["text"].cast("string").alias("text"), F.col(out)["hits"].alias("hits")))

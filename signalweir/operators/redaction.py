"""Reversible redaction: find values, number them per incident, swap them out and back.

Text rows carry incident_id, text_id (unique), text_seq (order of texts in the incident)
and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.functions.redaction import (
    CLOSE, OPEN, PLACEHOLDER, TOKEN, interim_token, with_scan,
)
from signalweir.scale import OrderedSlices
from signalweir.session import settle

_MAP_COLUMNS = ["incident_id", "placeholder", "type", "value", "token"]


def detect_sensitive(texts: DataFrame) -> DataFrame:
    """Add `interim` and `hits`: narrow work, a row at a time, no shuffle.

    Settle the result when it feeds both the numbering and the swap: it is the costly part.
    """
    done = with_scan(texts, "text", "_scan")
    return done.withColumns({"interim": F.col("_scan.text"), "hits": F.col("_scan.hits")}).drop("_scan")


def sensitive_hits(detected: DataFrame) -> DataFrame:
    """One row per hit."""
    # outer: a plain explode plants a size(hits) > 0 filter below, which would run the scan twice
    rows = detected.select("incident_id", "text_id", "text_seq", F.explode_outer("hits").alias("h"))
    return rows.where(F.col("h").isNotNull()).select("incident_id", "text_id", "text_seq", "h.*")


def number_placeholders(hits: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """A placeholder per distinct value of an incident, numbered per type by first appearance.

    The first type a value is seen under names it.  `seed` (incident_id, placeholder, type,
    value) is an earlier map: its values keep their placeholders and its numbers are not
    reused.  Distinct values are found by a partial aggregate; the numbering scans slices,
    so an incident with most of the values still spreads over many tasks.
    """
    first = hits.groupBy("incident_id", "value").agg(
        F.min(F.struct("text_seq", "detector", "position", "type")).alias("_f")
    )
    first = first.select(
        "incident_id", "value", "_f.type",
        F.col("_f.text_seq").alias("_s"), F.col("_f.detector").alias("_d"), F.col("_f.position").alias("_p"),
    )
    taken = F.lit(0).cast("bigint")
    known = None
    if seed is not None:
        known = settle(with_tokens(seed))
        # hits and seed meet by token: the hits' values hold tokens where the seed's hold placeholders
        first = first.withColumn("token", interim_token(F.col("value"))).join(
            known.select("incident_id", "token"), ["incident_id", "token"], "left_anti"
        )
        used = seed.groupBy("incident_id", "type").agg(
            F.max(F.regexp_extract("placeholder", f"_([0-9]+){CLOSE}", 1).cast("bigint")).alias("_used")
        )
        first = first.join(used, ["incident_id", "type"], "left")
        taken = F.coalesce(F.col("_used"), taken)
    slices = OrderedSlices(
        first.withColumn("_taken", taken),
        ["incident_id", "type"],
        [F.col("_s").asc(), F.col("_d").asc(), F.col("_p").asc(), F.col("value").asc()],
    ).rank("_n")
    number = (F.col("_n") + F.col("_taken")).cast("string")
    fresh = slices.frame().select(
        "incident_id",
        F.concat(F.lit(OPEN), F.col("type"), F.lit("_"), number, F.lit(CLOSE)).alias("placeholder"),
        "type",
        "value",
        interim_token(F.col("value")).alias("token"),
    )
    return _resolve_nested(fresh, known)


def _resolve_nested(mapping: DataFrame, known: DataFrame | None) -> DataFrame:
    """A value may itself hold tokens of earlier detectors, seen now or before: give it their placeholders."""
    every = mapping if known is None else mapping.unionByName(known)
    nested = mapping.where(F.col("value").rlike(TOKEN)).select(
        "incident_id", F.col("placeholder").alias("text_id"), F.col("value").alias("interim")
    )
    solved = redact(nested, every).select(
        "incident_id", F.col("text_id").alias("placeholder"), F.col("redacted").alias("_value")
    )
    return mapping.join(solved, ["incident_id", "placeholder"], "left").select(
        "incident_id", "placeholder", "type", F.coalesce("_value", "value").alias("value"), "token"
    )


def with_tokens(seed: DataFrame) -> DataFrame:
    """A stored map in the shape `redact` takes.

    The token of a value is that of its form in a scanned text, where inner values stand as
    tokens: stored inner placeholders become tokens first, innermost values before others.
    A pass that settles nothing more ends it, so a placeholder that is plain text stays.
    """
    rows = settle(seed.select("incident_id", "placeholder", "type", "value").withColumn("_form", F.col("value")))
    done, open_rows = rows.where(~_holds("_form")), rows.where(_holds("_form"))
    while not open_rows.isEmpty():
        tokens = done.select("incident_id", "placeholder", interim_token(F.col("_form")).alias("token"))
        named = open_rows.withColumn("text_id", F.col("placeholder"))
        swapped = settle(_swap(named, "_form", "_swapped", PLACEHOLDER, tokens, "placeholder", "token"))
        moved = swapped.where("_swapped != _form").drop("text_id", "_form").withColumnRenamed("_swapped", "_form")
        stuck = swapped.where("_swapped = _form").drop("text_id", "_swapped")
        done = settle(done.unionByName(moved.where(~_holds("_form"))).unionByName(stuck))
        open_rows = moved.where(_holds("_form"))
    return done.withColumn("token", interim_token(F.col("_form"))).select(*_MAP_COLUMNS)


def _holds(column: str) -> Column:
    return F.col(column).rlike(PLACEHOLDER)


def _opened(mapping: DataFrame) -> DataFrame:
    """(incident_id, placeholder, value) with the placeholders inside values opened too.

    Each pass opens values by the others as far as they are opened, so five reach a depth of
    thirty-two; there are twenty detectors.  A value that holds its own placeholder stays.
    """
    rows = settle(mapping.select("incident_id", "placeholder", "value"))
    for _ in range(5):
        nested = _holds("value") & ~F.contains("value", "placeholder")
        if rows.where(nested).isEmpty():
            break
        inner = rows.where(nested).withColumn("text_id", F.col("placeholder"))
        solved = _swap(inner, "value", "_to", PLACEHOLDER, rows, "placeholder", "value")
        rows = settle(
            rows.where(~nested).unionByName(solved.select("incident_id", "placeholder", F.col("_to").alias("value")))
        )
    return rows


def _swap(texts: DataFrame, column: str, out: str, pattern: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Replace each match of `pattern` in a text by its row in the incident's map.

    Matches travel as (text_id, match) rows and meet the map in an equi join, so the map of an
    incident is never gathered in one place; rows without a match are not shuffled for it.
    """
    finds = F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), F.lit(1))
    wanted = texts.select(
        "incident_id", "text_id", F.explode_outer(F.array_distinct(finds)).alias("_key")
    ).where(F.col("_key").isNotNull())
    pairs = (
        wanted.join(mapping.select("incident_id", F.col(key).alias("_key"), F.col(value).alias("_to")), ["incident_id", "_key"])
        .groupBy("incident_id", "text_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("_key", "_to"))).alias("_map"))
    )
    swapped = F.transform(finds, lambda t: F.coalesce(F.try_element_at(F.col("_map"), t), t))
    pieces = F.split(F.col(column), pattern, -1)
    rebuilt = F.array_join(F.zip_with(pieces, swapped, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return (
        texts.join(pairs, ["incident_id", "text_id"], "left")
        .withColumn(out, F.when(F.col("_map").isNull(), F.col(column)).otherwise(rebuilt))
        .drop("_map")
    )


def redact(detected: DataFrame, mapping: DataFrame) -> DataFrame:
    """Swap interim tokens for the numbered placeholders."""
    return _swap(detected, "interim", "redacted", TOKEN, mapping, "token", "placeholder")


def rehydrate(
    texts: DataFrame, mapping: DataFrame, column: str = "text", out: str = "restored", json: bool = False
) -> DataFrame:
    """Swap placeholders back for the values they stand for, values inside values included.

    With `json` the column holds JSON and values go in as the inside of a JSON string, so
    quotes, backslashes and line ends in them leave it valid.
    """
    values = _opened(mapping)
    if json:
        quoted = F.to_json(F.array("value"))
        values = values.withColumn("value", F.substr(quoted, F.lit(3), F.length(quoted) - 4))
    return _swap(texts, column, out, PLACEHOLDER, values, "placeholder", "value")


def new_mappings(mapping: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the map not stored yet (insert if absent on incident and placeholder)."""
    return mapping.join(stored.select("incident_id", "placeholder"), ["incident_id", "placeholder"], "left_anti")


def redaction_counts(mapping: DataFrame) -> DataFrame:
    """Distinct redacted values per incident and type."""
    return mapping.groupBy("incident_id", "type").agg(F.count("*").alias("values"))


# --- encryption of a column at rest ---

MARKER = "gcm1:"
_IV, _TAG = 12, 16


def encrypt_col(c: Column, key: Column) -> Column:
    """AES-GCM under a 16, 24 or 32 byte key: marker and base64 of iv, tag, ciphertext."""

    def laid_out(sealed: Column) -> Column:
        size = F.octet_length(sealed)
        iv = F.substring(sealed, 1, _IV)
        body = sealed.substr(F.lit(_IV + 1), size - _IV - _TAG)
        tag = sealed.substr(size - _TAG + 1, F.lit(_TAG))
        return F.concat(F.lit(MARKER), F.base64(F.concat(iv, tag, body)))

    # each call draws its own iv: bind the result once, then take it apart
    once = F.transform(F.array(F.aes_encrypt(c, key, F.lit("GCM"))), laid_out)
    return F.when(c.isNotNull(), F.element_at(once, 1))


def decrypt_col(c: Column, key: Column) -> Column:
    """Undo `encrypt_col`; text without the marker passes through."""
    raw = F.unbase64(c.substr(F.lit(len(MARKER) + 1), F.length(c)))
    size = F.octet_length(raw)
    iv = F.substring(raw, 1, _IV)
    tag = F.substring(raw, _IV + 1, _TAG)
    body = raw.substr(F.lit(_IV + _TAG + 1), size - _IV - _TAG)
    opened = F.aes_decrypt(F.concat(iv, body, tag), key, F.lit("GCM")).cast("string")
    return F.when(c.startswith(MARKER), opened).otherwise(c)

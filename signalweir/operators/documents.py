"""Knowledge documents: change detection, chunking, purge and reload, status, deletes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalweir.functions.chunking import pieces, sections
from signalweir.functions.text import content_hash, token_estimate
from signalweir.scale import OrderedSlices, top_per_key

MAX_CHARS = 1200
OVERLAP = 200
MIN_CHARS = 60
LIST_LIMIT = 100
_PLACE = ["tenant_id", "collection"]

_SECTIONS = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("content", T.StringType())]))


def document_changes(incoming: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """What each arriving document does: created, updated (version + 1) or unchanged.

    `incoming`: tenant_id, collection, source_uri (null for anonymous), content, arrival.
    `current`: tenant_id, collection, source_uri, content_hash, version.  A document with a
    path is compared with the version before it; an anonymous one is unchanged when any
    document of its collection holds the same content at that moment.
    """
    rows = incoming.withColumn("content_hash", content_hash(F.col("content")))
    path = [*_PLACE, "source_uri"]
    # the scans order hashes only; contents join the verdicts at the end
    heads = rows.select(*path, "arrival", "content_hash")
    named, anonymous = heads.where("source_uri IS NOT NULL"), heads.where("source_uri IS NULL")

    if current is None:
        known = named.withColumn("_hash0", F.lit(None).cast("string")).withColumn("_version0", F.lit(0).cast("bigint"))
    else:
        stored = current.where("source_uri IS NOT NULL").select(
            *path, F.col("content_hash").alias("_hash0"), F.col("version").cast("bigint").alias("_version0")
        )
        known = named.join(stored, path, "left").withColumn("_version0", F.coalesce("_version0", F.lit(0).cast("bigint")))
    scan = OrderedSlices(known, path, [F.col("arrival").asc()]).previous("_before", F.col("content_hash"))
    before = F.coalesce(F.col("_before"), F.col("_hash0"))
    action = (
        F.when(before.isNull(), F.lit("created")).when(before == F.col("content_hash"), F.lit("unchanged")).otherwise(F.lit("updated"))
    )
    scan.df = scan.df.withColumn("_held", before).withColumn("action", action)
    scan.running_sum("_changes", (F.col("action") != "unchanged").cast("bigint"))
    paths = scan.frame().withColumn("version", F.col("_version0") + F.col("_changes"))

    # which contents are held by some document at the moment an anonymous one arrives
    spot = [*_PLACE, "content_hash"]
    moved = paths.where("action <> 'unchanged'")
    one = F.lit(1).cast("bigint")
    nobody = F.lit(False)
    gains = moved.select(*spot, "arrival", one.alias("held"), nobody.alias("asks"))
    losses = moved.where(F.col("_held").isNotNull()).select(
        *_PLACE, F.col("_held").alias("content_hash"), "arrival", (-one).alias("held"), nobody.alias("asks")
    )
    held = gains.unionByName(losses)
    if current is not None:
        start = F.lit(-(2**62)).cast("bigint")
        held = held.unionByName(current.select(*spot, start.alias("arrival"), one.alias("held"), nobody.alias("asks")))
    asks = anonymous.select(*spot, "arrival", F.lit(0).cast("bigint").alias("held"), F.lit(True).alias("asks"))
    spots = asks.select(*spot).distinct()
    relevant = held.join(spots, spot, "left_semi")
    sweep = OrderedSlices(
        relevant.unionByName(asks), spot, [F.col("arrival").asc(), F.col("asks").asc(), F.col("held").asc()]
    ).running_sum("_holders", F.col("held"))
    sweep.df = sweep.df.withColumn("_free", F.col("asks") & (F.col("_holders") <= 0))
    sweep.running_sum("_nth_free", F.col("_free").cast("bigint"))
    verdicts = sweep.frame().where("asks").select(
        *spot,
        "arrival",
        F.when(F.col("_free") & (F.col("_nth_free") == 1), F.lit("created")).otherwise(F.lit("unchanged")).alias("action"),
        one.alias("version"),
    )
    out = [*rows.columns, "action", "version"]
    known_paths = rows.join(paths.select(*path, "arrival", "action", "version"), [*path, "arrival"])
    loose = rows.where("source_uri IS NULL").join(verdicts, [*spot, "arrival"])
    return known_paths.select(*out).unionByName(loose.select(*out))


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The document table after the changes: the last version of each path, pending again if it moved."""
    path = [*_PLACE, "source_uri"]
    last = changes.where("action <> 'unchanged' AND source_uri IS NOT NULL").groupBy(*path).agg(
        F.max_by(F.struct("content", "content_hash", "version"), "arrival").alias("_n")
    )
    fresh = last.select(*path, "_n.*").withColumn("status", F.lit("pending"))
    loose = changes.where("action = 'created' AND source_uri IS NULL").select(
        *path, "content", "content_hash", "version", F.lit("pending").alias("status")
    )
    kept = current.join(fresh.select(*path), path, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh).unionByName(loose)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """One row per section with a body: section index, heading trail, content.  No shuffle."""

    @F.pandas_udf(_SECTIONS)
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"heading": h, "content": b} for h, b in sections(t)] if t else [])

    rest = [c for c in docs.columns if c != "content"]
    found = docs.select(*rest, F.posexplode(split("content")).alias("section_index", "_s"))
    return found.select(*rest, F.col("section_index").cast("bigint").alias("section_index"), "_s.heading", "_s.content")


def chunk_documents(
    docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Retrieval chunks of each document: index, content with heading trail, token estimate.  No shuffle."""
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")

    @F.pandas_udf(_SECTIONS)
    def split(text: pd.Series) -> pd.Series:
        return text.map(
            lambda t: [
                {"heading": h, "content": f"[{h}]\n{p}" if h else p}
                for h, b in sections(t)
                for p in pieces(b, max_chars, overlap, min_chars)
            ]
            if t
            else []
        )

    rest = [c for c in docs.columns if c != "content"]
    found = docs.select(*rest, F.posexplode(split("content")).alias("chunk_index", "_c"))
    return found.select(
        *rest, F.col("chunk_index").cast("bigint").alias("chunk_index"), "_c.heading", "_c.content"
    ).withColumn("token_estimate", token_estimate(F.col("content")))


def document_status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status after processing: failed when nothing could be embedded, ready otherwise.

    A document without chunk rows has not been processed: it keeps its status.
    """
    counts = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.count("embedding").alias("embedded")
    )
    done = F.col("chunk_count").isNotNull()
    failed = done & (F.col("embedded") == 0)
    base = docs.drop("chunk_count", "embedded", "error")
    kept = F.col("status") if "status" in docs.columns else F.lit("pending")
    return (
        base.join(counts, "document_id", "left")
        .withColumn("status", F.when(failed, F.lit("failed")).when(done, F.lit("ready")).otherwise(kept))
        .withColumn("error", F.when(failed, F.lit("no chunks could be embedded")))
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")))
        .withColumn("embedded", F.coalesce("embedded", F.lit(0).cast("bigint")))
    )


def install_chunks(live: DataFrame, fresh: DataFrame, versions: DataFrame) -> DataFrame:
    """Purge and reload: documents with fresh chunks lose every old chunk.

    `fresh` carries document_id, version and the chunk columns; `versions` (document_id,
    version) is the newest version known.  Chunks of an older version are dropped as stale,
    and a document none of whose chunks could be embedded keeps its live ones.
    """
    newest = versions.groupBy("document_id").agg(F.max("version").alias("_newest"))
    current = fresh.join(newest, "document_id", "left").where(
        F.col("_newest").isNull() | (F.col("version") >= F.col("_newest"))
    )
    best = current.groupBy("document_id").agg(F.max("version").alias("_v"))
    current = current.join(best, "document_id").where(F.col("version") == F.col("_v")).drop("_newest", "_v")
    embedded = current.groupBy("document_id").agg(F.count("embedding").alias("_e")).where("_e > 0").select("document_id")
    installed = current.join(embedded, "document_id", "left_semi")
    kept = live.join(embedded, "document_id", "left_anti")
    return kept.unionByName(installed.select(*live.columns))


def delete_documents(docs: DataFrame, chunks: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete by (document_id, tenant_id), chunks included; a key of another tenant deletes nothing."""
    gone = docs.join(keys.select("document_id", "tenant_id"), ["document_id", "tenant_id"], "left_semi").select("document_id")
    return docs.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def list_documents(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest documents of every (tenant, collection)."""
    return top_per_key(docs, _PLACE, [F.col("created_at").desc(), F.col("document_id").desc()], limit, "position")

"""The registered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweir.llm import bpe, collocations, conversation_repair, decontaminate, exact_dedup, html_extract, language_id, licenses, near_dedup, packing, sharding, toxicity, url_filter
from signalweir.llm.common import held_out, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the ids of byte_bpe_50k.json
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ADDED = bpe.added_tokens(BPE_FILE)
#: Rules of the URL filter: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Host labels whose pages are listed one by one.
LISTED_LABELS = "(^|[.])(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)[.]"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), VOCABULARY, added=ADDED)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), out="c")
    items = F.array_sort(decontaminate.hit_items(F.col("c.spans")))
    hit = decontaminate.hit_words(F.col("c.spans"))
    return found.select(
        "doc_id", F.col("c.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("c.spans") > 0).alias("contaminated"),
    )


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op4_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS n FROM documents),
g AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_report(read(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda p: p["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(read(spark, sf_dir, "documents"), 24)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    host, path = url_filter.host_and_path(F.col("url"))
    bad = pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(LISTED_LABELS))
    host, path = url_filter.canonical(F.col("host"), F.col("path"))
    found = url_filter.judge_urls(pages, rules, bad.select(host.alias("host"), path.alias("path")))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLES["op9_url_filter"] = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM a),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, s, verdict)),
f AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(verdict, length(h || s)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict,
  CASE WHEN regexp_matches(p.host, '(^|[.])(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)[.]') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id
"""


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = html_extract.extracted(pages, html_extract.fit(pages))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows damaged, by a checksum of conversation and turn."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hit = conversations.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 3, 2).when(how == 0, 0).otherwise(1).alias("times"),
    )
    return hit.where("times > 0").withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    repair = conversation_repair.Repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    report = repair.report().withColumnRenamed("conv", "r_conv").withColumn("_there", F.lit(True))
    digests = repair.digests().withColumnRenamed("conv", "d_conv")
    found = every.join(report, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), BPE_FILE), BPE_FILE)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(read(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

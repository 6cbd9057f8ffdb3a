"""URL rules behind a blocked Bloom filter.

Listed canonical URLs (host and path prefix, each to block or to allow) set eight bits in
one 512-bit block of a Bloom filter. Of a page's URL every host suffix is paired with every
path prefix of a listed length; keys that the filter passes go to an exact hash join with
the list, which removes the false positives, and the longest rule that is left wins.

The filter's blocks are bounded by a parameter, so its broadcast is bounded whatever the
list: a list too long for it lets more false positives through to the join, no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweir.llm.common import LOWER, UPPER

PROBES = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first `://` up to `/`, `?`, `#` or end; path from there up to `?`, `#` or end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """The form that listed URLs take: no `www.`, no default port, no `.html`, no slash at the end."""
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return host, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")


def _probes(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the bits (0 to 511) it sets there: double hashing inside the block."""
    one, two = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    step = F.shiftrightunsigned(two, 32).bitwiseOR(F.lit(1))
    return F.pmod(one, F.lit(blocks)).cast("int"), [
        (F.shiftrightunsigned(two, 3) + i * step).bitwiseAND(F.lit(511)).cast("int") for i in range(PROBES)
    ]


def blocked_bloom(keys: DataFrame, key: str, bits_per_key: int = 16, max_blocks: int = 1 << 16) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the blocks with a bit set, and the number of blocks (64 bytes each, at most `max_blocks`)."""
    n = keys.count()
    blocks = min(max_blocks, max(1, -(-n * bits_per_key // 512)))
    block, bits = _probes(F.col(key), blocks)
    spread = keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit"))
    words = [
        F.bit_or(F.when(F.expr("_bit div 64") == w, F.expr("shiftleft(1L, _bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in range(8)
    ]
    return spread.groupBy("_block").agg(*words), blocks


def _passes(bits: list[Column]) -> Column:
    words = F.array(*[F.col(f"w{w}") for w in range(8)])
    return reduce(
        lambda a, b: a & b,
        [F.getbit(F.element_at(words, (F.floor(bit / 64) + 1).cast("int")), (bit % 64).cast("int")) == 1 for bit in bits],
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
    bits_per_key: int = 16, max_blocks: int = 1 << 16,
) -> DataFrame:
    """One row per page: id, host, path, rule (host and path prefix, else null), listed (boolean), verdict.

    rules: (host, path, verdict) prefixes that fit a host and its subdomains; listed:
    (host, path) canonical URLs to block where no rule fits. Of rules of equal length the
    one that allows wins. Null urls and those without `://` have empty host and path, fit
    nothing and are allowed. Repeated rows are each judged. Empty lists allow everything.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = rows.where("host != ''").select("host", "path").distinct()
    chost, cpath = canonical(F.col("host"), F.col("path"))
    gap = F.lit("\u0001")
    entries = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.concat(F.lit("r"), "host", gap, "path").alias("_key"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"))
        .groupBy("_key").agg(F.min("_rule").alias("_rule"), F.min("_verdict").alias("_verdict"))
        .unionByName(
            listed.where("host IS NOT NULL AND path IS NOT NULL")
            .select(F.concat(F.lit("u"), "host", gap, "path").alias("_key")).distinct()
            .select("_key", F.lit(None).cast("string").alias("_rule"), F.lit("block").alias("_verdict"))
        )
    )
    # distinct lengths of listed paths: bounded by the longest URL that a rule can hold
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"),
        lambda p: p.isNotNull(),
    )
    ruled = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r"), s, gap, p))))
    keys = urls.select("host", "path", F.explode(F.concat(F.array(F.concat(F.lit("u"), chost, gap, cpath)), ruled)).alias("_key"))
    bloom, blocks = blocked_bloom(entries, "_key", bits_per_key, max_blocks)
    block, bits = _probes(F.col("_key"), blocks)
    hits = (
        keys.withColumn("_block", block)
        .join(F.broadcast(bloom), "_block")  # at most max_blocks x 64 bytes
        .where(_passes(bits))
        .select("host", "path", "_key")
    )
    fits = hits.join(entries, "_key")
    best = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("_rule").isNotNull(), F.struct(F.length("_rule").alias("n"), F.col("_verdict") == "allow", F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")))).alias("_best"),
        F.max(F.col("_rule").isNull()).alias("_listed"),
    ).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "_best", "_listed")
    listed_too = F.coalesce("_listed", F.lit(False))
    return rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        "id", "host", "path", F.col("_best.rule").alias("rule"), listed_too.alias("listed"),
        F.coalesce(F.col("_best.verdict"), F.when(listed_too, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )

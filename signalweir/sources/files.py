"""Log files: line rows in file order, mis-named gzip files, binary files set apart."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNIFF_BYTES = 8192
BINARY_SHARE = 0.3


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, line_no, raw for text files and .gz files.

    `line_no` is (block, row): blocks of one file may be read by different tasks, and within
    a block rows come in order, so the pair sorts lines as they stand in the file.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line_no = F.struct(F.col("_metadata.file_block_start").alias("block"), row.alias("row"))
    return raw.select(F.col("_metadata.file_path").alias("source_file"), line_no.alias("line_no"), F.col("value").alias("raw"))


def misnamed_gzip(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold gzip data without a gzip name, with their content.

    The first row of a file tells; rows are streamed, no file is held whole for it.  Only the
    names of the files found reach the driver, and only those files are then read whole.
    """
    lines = read_log_lines(spark, paths)
    head = F.substring(F.col("raw").cast("binary"), 1, 2) == F.unhex(F.lit("1F8B"))
    start = lines.where("line_no.block = 0").groupBy("source_file").agg(F.min_by(head, "line_no").alias("_gz"))
    names = start.where(F.col("_gz") & ~F.lower("source_file").rlike(r"\.g(z|zip)\z")).select("source_file")
    found = [r.source_file for r in names.collect()]
    if not found:
        return spark.createDataFrame([], "source_file string, content binary")
    files = spark.read.format("binaryFile").load(found)
    return files.select(F.col("path").alias("source_file"), "content")


def read_gzip_lines(files: DataFrame) -> DataFrame:
    """Line rows of the files `misnamed_gzip` lists (also of *.gzip, whose name no codec claims).

    A file may be several gzip members one after another; all are read.  What follows the
    last member and is no member itself is left out, as gunzip does.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["source_file"], batch["content"]):
                row, tail = 0, b""
                for part in _members(content):
                    *whole, tail = (tail + part).split(b"\n")
                    lines = [w.decode("utf-8", "replace") for w in whole]
                    if lines:
                        yield pd.DataFrame({"source_file": name, "row": range(row, row + len(lines)), "raw": lines})
                        row += len(lines)
                if tail:
                    yield pd.DataFrame({"source_file": [name], "row": [row], "raw": [tail.decode("utf-8", "replace")]})

    rows = files.mapInPandas(unpack, "source_file string, row long, raw string")
    line_no = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("row"))
    return rows.select("source_file", line_no.alias("line_no"), "raw")


def _members(content: bytes) -> Iterator[bytes]:
    """The plain bytes of every gzip member, a piece at a time."""
    rest = memoryview(content)
    while rest[:2] == b"\x1f\x8b":
        member, at = zlib.decompressobj(wbits=31), 0
        while at < len(rest) and not member.eof:
            yield member.decompress(rest[at : at + (1 << 20)])
            at += 1 << 20
        yield member.flush()
        rest = rest[min(at, len(rest)) - len(member.unused_data) :] if member.eof else rest[:0]


def binary_files(lines: DataFrame) -> DataFrame:
    """source_file of files that are not text, judged by their first 8192 bytes.

    A line takes at least one byte, so at most 8192 rows of a file are looked at: those whose
    row number is that close to the first row of the file.
    """
    at_start = lines.where("line_no.block = 0")
    first = at_start.groupBy("source_file").agg(F.min("line_no.row").alias("_first"))
    head = at_start.join(first, "source_file").where(F.col("line_no.row") - F.col("_first") < SNIFF_BYTES)
    w = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("raw") + 1).over(w), F.lit(0))
    room = F.lit(SNIFF_BYTES) - F.col("_before")
    piece = F.substring(F.col("raw").cast("binary"), 1, SNIFF_BYTES)
    seen = head.withColumn("_before", before).where(F.col("_before") < SNIFF_BYTES)
    cut = F.decode(F.substr(piece, F.lit(1), room.cast("int")), "ISO-8859-1")
    control = F.call_function("regexp_count", cut, F.lit(r"[\x01-\x08\x0e-\x1f]"))
    size = F.least(F.octet_length("raw") + 1, room)
    return (
        seen.groupBy("source_file")
        .agg(
            F.max(F.contains(cut, F.char(F.lit(0)))).alias("_nul"),
            F.sum(control).alias("_control"),
            F.sum(size).alias("_size"),
        )
        .where(F.col("_nul") | (F.col("_control") / F.col("_size") > BINARY_SHARE))
        .select("source_file")
    )


def quarantine_binary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of text files, binary file names)."""
    bad = binary_files(lines)
    return lines.join(bad, "source_file", "left_anti"), bad

import gzip

import pytest
from pyspark.sql import functions as F

from signalweir.functions import logs as L
from signalweir.operators import logs, matching
from signalweir.registry import QUERIES
from signalweir.sources import files


def _lines(spark, *raws, incident="i", source="a.log"):
    rows = [(incident, source, n, r) for n, r in enumerate(raws)]
    return spark.createDataFrame(rows, "incident_id string, source_file string, line_no long, raw string")


def test_trim_and_blank(spark):
    kept = logs.retain_lines(logs.prepare_lines(_lines(spark, "  a  ", "", "   ", "b ")))
    assert logs.retained_text(kept).first().text == "a\nb"


def test_earliest_survive_and_buried_fatal_is_kept(spark):
    raws = [f"2026-07-14T10:{i // 60:02d}:{i % 60:02d}Z INFO line {i}" for i in range(3000, 0, -1) if i < 3600]
    raws.append("2026-07-14T11:30:00Z FATAL pool exhausted")
    lines = _lines(spark, *raws)
    prepared = logs.prepare_lines(lines)
    kept = logs.retain_lines(prepared, max_bytes=2000)
    text = logs.retained_text(kept).first().text.split("\n")
    assert text[0].endswith("line 1") and "FATAL" in text[-1]
    stats = logs.retention_stats(lines, prepared, kept).first()
    assert stats.truncated and stats.severe_lines == 1 and stats.total_lines == 3001
    first = sum(len(t) + 1 for t in text[:-1])
    assert first <= 800


def test_every_byte_and_source_counts(spark):
    lines = _lines(spark, "  hello  ", "   ").unionByName(_lines(spark, "  ", source="blank.log"))
    prepared = logs.prepare_lines(lines)
    stats = {r.source_file: r for r in logs.retention_stats(lines, prepared, logs.retain_lines(prepared)).collect()}
    assert (stats["a.log"].total_bytes, stats["a.log"].total_lines) == (14, 1)
    assert (stats["blank.log"].total_bytes, stats["blank.log"].total_lines, stats["blank.log"].truncated) == (3, 0, False)
    assert logs.fuse_stats(lines, logs.fuse_lines(prepared)).first().source_count == 2


def test_excerpt_takes_short_lines_up_to_its_length(spark):
    placed = spark.createDataFrame([("i", n, n * 5, "term") for n in range(900)], "incident_id string, line_index long, offset long, line string")
    asked = spark.createDataFrame([("q", "i", ["term"])], "question_id string, incident_id string, terms array<string>")
    assert len(logs.keyword_excerpt(placed, asked, 2500).first().excerpt) == 2500


def test_budget_stops_at_the_first_line_that_overflows(spark):
    raws = ["2024-01-01 00:00:01 aaaa", "2024-01-01 00:00:02 " + "b" * 200, "2024-01-01 00:00:03 c"]
    kept = logs.retain_lines(logs.prepare_lines(_lines(spark, *raws)), max_bytes=150)
    assert [r.line_no for r in kept.collect()] == [0]


def test_untimed_last_and_apache_sorts_last(spark):
    raws = ["no stamp", "14/Jul/2026:10:00:00 apache", "2026-07-14T10:00:01Z real"]
    placed = logs.positions(logs.fuse_lines(logs.prepare_lines(_lines(spark, *raws))))
    got = [r.line for r in placed.orderBy("line_index").collect()]
    assert got == [
        "[a.log] 2026-07-14T10:00:01Z | 2026-07-14T10:00:01Z real",
        "[a.log] no-timestamp | no stamp",
        "[a.log] 14/Jul/2026:10:00:00 | 14/Jul/2026:10:00:00 apache",
    ]


def test_two_sources_merge_and_repeats_drop(spark):
    rows = _lines(spark, "2024-01-01T10:00:02Z b", "ERROR   db down", source="b.log").unionByName(
        _lines(spark, "2024-01-01T10:00:01Z a", "ERROR db DOWN", source="a.log")
    )
    prepared = logs.prepare_lines(rows)
    fused = logs.fuse_lines(prepared)
    assert [r.raw for r in logs.positions(fused).orderBy("line_index").collect()] == [
        "2024-01-01T10:00:01Z a", "2024-01-01T10:00:02Z b", "ERROR db DOWN"
    ]
    assert logs.fuse_stats(rows, fused).first().source_count == 2


@pytest.mark.parametrize(
    "line, level",
    [("kernel panic: boom", 3), ("alert raised", 3), ("Caused by: x", 2), ("java at a.B$c(D.java:12)x", 2), ("at a.b(C.java:1)", 0),
     ("warning issued", 1), ("errors", 0), ("unwarned", 0), ("éERROR", 2)],
)
def test_severity(spark, line, level):
    assert spark.createDataFrame([(line,)], "l string").select(L.severity_class(F.col("l"))).first()[0] == level


@pytest.mark.parametrize("limit, most", [(200, 100), (130, 5), (45, 12)])
def test_line_chunks(spark, limit, most):
    raws = [f"2024-01-01 00:{i:02d}:00 " + "x" * ((i * 37) % 50) for i in range(60)]
    placed = logs.positions(logs.fuse_lines(logs.prepare_lines(_lines(spark, *raws))))
    lines = [r.line for r in placed.orderBy("line_index").collect()]
    got = [r.content for r in logs.line_chunks(placed, limit, most).orderBy("chunk_index").collect()]
    assert len(got) <= most and all(len(c) <= limit for c in got)
    if max(map(len, lines)) <= limit:  # whole lines, in order, and no chunk could have taken one more
        text = "\n".join(got)
        assert "\n".join(lines).startswith(text) and (len(got) == most or text == "\n".join(lines))
        assert all(len(a) + 1 + len(b.split("\n")[0]) > limit for a, b in zip(got, got[1:]))
    else:  # lines over the limit are cut, each piece on its own
        assert "".join(lines).startswith("".join(got).replace("\n", ""))
        assert len(got) == most


def test_registered_chunks_cover_whole_lines(spark):
    rows = QUERIES["d4_line_chunks"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(len(r.content) <= 2000 for r in rows)


def test_keyword_excerpt(spark):
    raws = [f"2024-01-01 00:{i:02d}:00 {'timeout' if i % 4 == 0 else 'fine'} n{i}" for i in range(50)]
    placed = logs.positions(logs.fuse_lines(logs.prepare_lines(_lines(spark, *raws))))
    lines = [r.line for r in placed.orderBy("line_index").collect()]
    asked = spark.createDataFrame(
        [(1, "i", ["timeout"]), (2, "i", ["absent"]), (3, "i", []), (4, "i", ["N7", "x"]), (5, "none", ["timeout"])],
        "question_id long, incident_id string, terms array<string>",
    )

    def expect(terms, limit):
        found = [n for n in lines if any(t.lower() in n.lower() for t in terms if len(t) > 1)]
        return "\n".join(found or lines)[:limit]

    want = {1: expect(["timeout"], 300), 2: expect(["absent"], 300), 3: expect([], 300), 4: expect(["N7", "x"], 300), 5: ""}
    got = {r.question_id: r.excerpt for r in logs.keyword_excerpt(placed, asked, 300).collect()}
    assert got == want
    assert not any(step in logs.keyword_excerpt(placed, asked, 300)._jdf.queryExecution().toString() for step in ("MapInPandas", "ArrowEvalPython"))


def test_few_runs_leave_a_text(spark):
    texts = spark.createDataFrame([(i, "t", f"line {i} of plain words, {'db-main down' if i % 100 == 0 else 'nothing else'}") for i in range(500)], "id long, tenant_id string, text string")
    names = spark.createDataFrame([("t", "db-main"), ("t", "ab"), ("t", "of p"), ("u", "line"), (None, "line"), ("t", None), ("t", "")], "tenant_id string, name string")
    found = matching.names_in_texts(texts, names, ["id"])
    assert {(r.id, r["name"]) for r in found.collect()} == {(i, "db-main") for i in range(0, 500, 100)} | {(i, "of p") for i in range(500)}
    assert matching.names_in_texts(texts, names.limit(0), ["id"]).count() == 0


def test_files(spark, tmp_path):
    text = "".join(f"2024-01-01T00:00:{i % 60:02d}Z line {i}\r\n" for i in range(500))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    (tmp_path / "c.log").write_bytes(b"\x00\x01\x02binary\nrest\n")
    (tmp_path / "d.log").write_bytes(b"\x01\x02\x03\x04x\n" * 10)
    (tmp_path / "e.log").write_bytes(gzip.compress(b"hidden gz line\nnext"))
    lines = files.read_log_lines(spark, str(tmp_path))
    text_lines, bad = files.quarantine_binary(lines)
    names = {r.source_file.rsplit("/", 1)[1] for r in bad.collect()}
    assert {"c.log", "d.log"} <= names and not names & {"a.log", "b.log.gz"}
    a = text_lines.where(F.col("source_file").endswith("a.log")).orderBy("line_no")
    assert [r.raw.strip() for r in a.collect()] == text.split("\r\n")[:-1]
    assert {r.raw for r in text_lines.where(F.col("source_file").endswith("b.log.gz")).collect()} == {"one", "two"}
    hidden = files.misnamed_gzip(spark, str(tmp_path))
    assert [r.source_file.rsplit("/", 1)[1] for r in hidden.select("source_file").collect()] == ["e.log"]
    assert [r.raw for r in files.read_gzip_lines(hidden).orderBy("line_no").collect()] == ["hidden gz line", "next"]


def test_every_gzip_member_is_read(spark, tmp_path):
    parts = [b"one\ntw", b"o\nthree\n" * 3, b"four"]
    (tmp_path / "m.log").write_bytes(b"".join(map(gzip.compress, parts)) + b"junk")
    (tmp_path / "n.log").write_bytes(gzip.compress(b"a\n" * 900_000))
    got = files.read_gzip_lines(files.misnamed_gzip(spark, str(tmp_path)))
    assert [r.raw for r in got.where(F.col("source_file").endswith("m.log")).orderBy("line_no").collect()] == b"".join(parts).decode().split("\n")
    assert got.where(F.col("source_file").endswith("n.log")).count() == 900_000


def test_line_order_survives_file_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i:06d}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = files.read_log_lines(spark, str(tmp_path / "big.log"))
        assert lines.rdd.getNumPartitions() > 2
        assert [r.raw for r in lines.orderBy("line_no").collect()] == [f"line {i:06d}" for i in range(20000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hard_split(spark):
    got = logs.hard_split(_lines(spark, "x" * 25, "short"), 10).orderBy("line_no", "piece").collect()
    assert [r.raw for r in got] == ["x" * 10, "x" * 10, "x" * 5, "short"]


def test_keyword_excerpt_in_blocks(spark, monkeypatch):
    """Blocks of lines and terms lose nothing, and lines meet the terms in a pass, not by their runs of characters."""
    monkeypatch.setattr(matching, "BLOCK_TEXTS", 7, raising=False)
    monkeypatch.setattr(matching, "BLOCK_NAMES", 2, raising=False)
    rows = [(i, n, f"line {n} of {'ALPHA' if n % 3 else 'beta'} é{n % 5} {'İx' * (n % 4)}") for i in ("a", "b", None) for n in range(60)]
    placed = spark.createDataFrame([(i, n, line, n * 10) for i, n, line in rows], "incident_id string, line_index long, line string, offset long")
    terms = {1: ["alpha"], 2: ["beta", "é3"], 3: ["line 5", "of", "ine 1", "é0", "zz"], 4: ["nothing"], 5: ["alpha", "e 59"]}
    asked = spark.createDataFrame([(q, "ab"[q % 2], t) for q, t in terms.items()] + [(9, None, ["line"])], "question_id long, incident_id string, terms array<string>")
    excerpts = logs.keyword_excerpt(placed, asked, 150)
    got = {r.question_id: r.excerpt for r in excerpts.collect()}
    for q, t in terms.items():
        mine = [line for i, n, line in rows if i == "ab"[q % 2]]
        assert got[q] == "\n".join([x for x in mine if any(w in x.lower() for w in t)] or mine)[:150]
    assert got[9] == "" and "regexp_extract_all" not in excerpts._jdf.queryExecution().toString()

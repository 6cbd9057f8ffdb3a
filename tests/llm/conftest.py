import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.01"
#: Null, empty, blank, repeated rows, ties, a clashing column, a very long text.
AWKWARD = [
    (1, "Same text here for you and me today", "en", "a", 1, "x"),
    (1, "Same text here for you and me today", "en", "a", 1, "x"),
    (2, "Same  text here\nfor you and me today", "en", None, 1, "x"),
    (3, None, None, "a", None, None),
    (4, "", "en", "b", 0, "x"),
    (5, " \t\n", "en", "b", 3, None),
    (None, "no id at all", "de", "b", 1, "x"),
    (None, None, None, None, None, None),
    (6, "!!! ... ???", "fr", "b", 1, "x"),
    (7, "word " * 50_000, "en", "a", 1, "x"),
    (8, "ümläut é 日本語 🙂 text", "fr", "c", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

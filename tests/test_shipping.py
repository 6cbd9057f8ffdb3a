"""Tasks must not need the package on the executors' path."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
for name in ("d3_markdown_chunks", "v1_semantic_search", "k3_execution_order"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
assert len(entry.entry(spark).columns) > 0
print("shipped")
"""


def test_queries_run_from_any_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "shipped" in done.stdout, done.stderr[-2000:]

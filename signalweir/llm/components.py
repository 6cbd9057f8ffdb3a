"""Connected components by contraction: no key's neighbours are ever gathered.

Each round every node moves to the one of itself and its neighbours whose hash is least
(the hash changes with the round), links follow their ends, and links inside one node go.
Random order makes the graph shrink by a constant factor a round, also for long chains, so
rounds grow with the logarithm of the longest one. Minima are partial aggregates; joins on
a hot node are sort-merge joins that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweir.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root) of every node that has a link to another; root is one node of its component.

    Null ends, loops and repeated links are left out. No links give an empty result.
    """
    links = written(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    moves: list[DataFrame] = []
    while not links.isEmpty():
        turn = F.lit(len(moves))

        def ranked(c):
            return F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("n"))

        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        move = written(near.select(F.col("a").alias("node"), F.least(F.col("m"), ranked("a"))["n"].alias("to")))
        one = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = written(
            links.join(one, "a").join(two, "b").where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        moves.append(move)
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        found = found.join(move.withColumnRenamed("node", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return found

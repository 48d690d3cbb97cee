"""Connected components by alternating large and small stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import stored

#: Edges per task: a round over few edges need not start a task per partition.
EDGES_PER_TASK = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); root is the smallest node
    of its component and not listed itself. Ids are of any orderable type; loops
    are ignored. Every round is written to the shared folder; the number of rounds
    grows with the logarithm of the size."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(),
                 "edges")
    seen = _digest(now)
    while True:
        tasks = max(1, -(-seen[0] // EDGES_PER_TASK))
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            "u", "m", F.explode(F.array("u", "v")).alias("w")).where("w != m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        now = stored(small.coalesce(tasks).distinct().coalesce(tasks), "edges")
        last, seen = seen, _digest(now)
        if last == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

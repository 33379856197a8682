"""Connected components of an edge table by alternating large-star and small-star steps.

All state is in tables; the driver gets a count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight.staging import stage


def _star(pairs: DataFrame, smaller: bool) -> DataFrame:
    """Connect each node's larger (or smaller) neighbours to the smallest node of its neighbourhood.

    ``pairs`` has ``a > b``. Minima combine before the shuffle; the join back lets the planner
    split a hub's neighbours over tasks.
    """
    both = pairs if smaller else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("k"))
    if smaller:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: every node of ``edges`` (``a``, ``b``) but the roots, with the smallest node it reaches."""
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table, seen = stage(oriented, "edges"), None
    for _ in range(rounds):
        mark = tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen or not mark[0]:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        table = stage(_star(_star(table, smaller=False), smaller=True), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")

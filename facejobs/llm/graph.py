"""Connected components of an edge table by alternating large and small stars.

Each round hangs every node on smaller ones until the edges form stars. Rounds grow with the
logarithm of the graph's size. Every round is written to the shared folder, so a lost executor
costs part of a round; nothing but row counts and checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Of each node, the larger neighbours hang on the smallest of it and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of each node, it and its smaller neighbours hang on the smallest of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node it can reach.

    ``edges`` has columns u, v of one type that orders; rows repeat, point either way or at
    themselves freely, and nulls are dropped. No edges give no rows.
    """
    edges = common.stage(edges.select("u", "v").where("u <> v"), "edges")
    before = _state(edges)
    for _ in range(most_rounds):
        earlier, edges = edges, common.stage(_small_star(_large_star(edges)), "edges")
        common.discard(earlier)
        if (now := _state(edges)) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"not settled after {most_rounds} rounds")

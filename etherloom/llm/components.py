"""Connected components of an edge table by alternating stars, cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stash


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """``edges(u, v)``, u > v, about ``n``. Large star: link the greater neighbours of each node to its least one; small star: the lesser ones."""
    if large:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).union(edges.select("v", "u"))
    else:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("x"))
    # min() is merged in each task before the shuffle; the join back spreads a hub over many tasks
    least = around.groupBy("n").agg(F.min("x").alias("m"), F.count("*").alias("c")).select("n", F.least("n", "m").alias("m"), "c")
    joined = spread_join(around, least, "n", "c", n)
    if large:
        out = joined.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("x").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n"), F.col("m")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of the component of each node that has an edge (``a, b``, both bigint, any order)."""
    now = stash(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = stash(_star(_star(now, True, 2 * state[0]), False, state[0]), "edges")
